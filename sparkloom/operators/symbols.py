"""Symbols by rules (built-in functions) and by the declaration scanner (Arrow batches, a file at a time)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import parsing, rules, text
from sparkloom.sources.workers import importable


def by_rules(files: DataFrame, file: str = "file", content: str = "content", language: str = "language") -> DataFrame:
    """A symbol for each line and pattern of the file's language: its first match."""
    lines = files.select(F.col(file).alias("file"), F.col(language).alias("language"), F.posexplode(text.lines(F.col(content))).alias("n", "line"))
    out = F.array().cast("array<struct<kind:string,name:string>>")
    for lang, patterns in rules.SYMBOLS.items():
        known = ("typescript", "javascript") if lang == "typescript" else ("c", "cpp") if lang == "c" else (lang,)
        hits = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract("line", p, 1).alias("name")) for k, p in patterns])
        out = F.when(F.col("language").isin(*known), hits).otherwise(out)
    s = lines.withColumn("s", F.explode(out)).where("s.name != ''")
    return s.select("file", "language", F.col("s.name").alias("name"), F.col("s.kind").alias("kind"), (F.col("n") + 1).alias("line"), F.lit(0).alias("column"), F.trim("line").alias("context_snippet"), F.lit("module").alias("containing_scope"))


_ANNOTATIONS = "array<struct<name:string,arguments:array<string>,line:bigint>>"
_COLUMNS = [
    ("record", "string", pa.string()), ("file", "string", pa.string()), ("language", "string", pa.string()), ("id", "string", pa.string()), ("name", "string", pa.string()), ("kind", "string", pa.string()),
    ("start_line", "bigint", pa.int64()), ("end_line", "bigint", pa.int64()), ("column", "bigint", pa.int64()), ("visibility", "string", pa.string()), ("parent", "string", pa.string()), ("signature", "string", pa.string()),
    ("doc", "string", pa.string()), ("context", "string", pa.string()), ("caller", "string", pa.string()),
    ("annotations", _ANNOTATIONS, pa.list_(pa.struct([("name", pa.string()), ("arguments", pa.list_(pa.string())), ("line", pa.int64())]))),
]
_SCHEMA = pa.schema([(n, t) for n, _, t in _COLUMNS])


def _records(file: str, language: str, content: str) -> Iterator[dict]:
    symbols, calls, imports = parsing.parsed(content, language)
    same = {"file": file, "language": language}
    key = {s.name: f"{file}::{s.name}::{s.kind}" for s in symbols}
    for s in symbols:
        yield same | {"record": "symbol", "id": f"{file}::{s.name}::{s.kind}", "name": s.name, "kind": s.kind, "start_line": s.start, "end_line": s.end, "column": s.at - (content.rfind("\n", 0, s.at) + 1), "visibility": s.visibility, "parent": s.parent, "signature": s.signature, "doc": s.doc, "annotations": [{"name": a, "arguments": b, "line": c} for a, b, c in s.annotations]}
    for caller, name, line in calls:
        yield same | {"record": "call", "caller": key.get(caller, caller), "name": name, "start_line": line}
    for name, line in imports:
        yield same | {"record": "import", "name": name, "start_line": line}
    for name, line, column, kind, context in parsing.references(content, language, symbols):
        yield same | {"record": "reference", "id": key[name], "name": name, "start_line": line, "column": column, "kind": kind, "context": context}


def analysed(files: DataFrame, file: str = "file", content: str = "content", language: str = "language") -> DataFrame:
    """One table of records of the files; ``record`` is symbol, call, import or reference.  Files of unknown language have none."""

    importable(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, lang, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if rows := list(_records(f, lang or "", c or "")):
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return files.select(F.col(file), F.col(language), F.col(content)).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t, _ in _COLUMNS))


def symbols(records: DataFrame) -> DataFrame:
    s = records.where("record = 'symbol'").drop("record", "context", "caller")
    return s.withColumn("qualified_name", F.concat_ws(".", "parent", "name"))


def calls(records: DataFrame) -> DataFrame:
    return records.where("record = 'call'").select("file", F.col("caller").alias("src"), F.col("name").alias("dst"), F.col("start_line").alias("line"))


def imports(records: DataFrame) -> DataFrame:
    return records.where("record = 'import'").select(F.col("file").alias("from_file"), F.col("name").alias("to_file"), F.col("start_line").alias("line"))


def references(records: DataFrame) -> DataFrame:
    return records.where("record = 'reference'").select(F.col("id").alias("symbol_id"), "file", "name", F.col("start_line").alias("line"), "column", F.col("kind").alias("ref_kind"), "context")


def uses(records: DataFrame) -> DataFrame:
    """Use edges (read, write, move, borrow) have a type but no producer: always empty."""
    return records.where("false").select(F.col("id").alias("user"), F.col("name").alias("used"), F.col("kind").alias("use_kind"))


def generated(symbols: DataFrame) -> DataFrame:
    """Generated members by annotation: Lombok's on Java, derives on Rust; and data classes and records by their head."""
    a = symbols.select("file", "language", F.explode("annotations").alias("a"))
    members = F.create_map(*[c for k, v in rules.LOMBOK.items() for c in (F.lit(k), F.array(*map(F.lit, v)))])
    lombok = a.where((F.col("language") == "java") & F.col("a.name").isin(*rules.LOMBOK)).select("file", F.col("a.line").alias("line"), F.lit("Lombok").alias("pattern_type"), F.element_at(members, F.col("a.name")).alias("members"), F.concat(F.lit("@"), "a.name").alias("source_annotation"))
    known = F.create_map(*[F.lit(x) for kv in rules.DERIVES.items() for x in kv])
    derive = a.where("language = 'rust' AND a.name = 'derive' AND size(a.arguments) > 0").select(
        "file", F.col("a.line").alias("line"), F.lit("RustDerive").alias("pattern_type"), F.transform("a.arguments", lambda x: F.coalesce(known[x], F.concat(x, F.lit(" impl")))).alias("members"),
        F.concat(F.lit("#[derive("), F.array_join("a.arguments", ", "), F.lit(")]")).alias("source_annotation"),
    )
    return lombok.unionByName(derive)


def heads(files: DataFrame, content: str = "content") -> DataFrame:
    """Kotlin data classes and C# records: what they generate, by line."""
    lines = files.select("file", "language", F.posexplode(text.lines(F.col(content))).alias("n", "line"))
    kt = (F.col("language") == "kotlin") & F.trim("line").startswith("data class")
    cs = (F.col("language") == "csharp") & F.col("line").rlike(r"\brecord\s+\w+")
    members = F.when(kt, F.array(*map(F.lit, ("equals()", "hashCode()", "toString()", "copy()", "componentN()")))).otherwise(F.array(*map(F.lit, ("Equals()", "GetHashCode()", "ToString()", "Deconstruct()"))))
    return lines.where(kt | cs).select("file", (F.col("n") + 1).alias("line"), F.when(kt, "KotlinDataClass").otherwise("CSharpRecord").alias("pattern_type"), members.alias("members"))


#: Languages that are cut by declarations; others by lines.
ROUTED = ("rust", "typescript", "javascript", "python")


def chunks(files: DataFrame, file: str = "file", content: str = "content", language: str = "language", routed: tuple[str, ...] = ROUTED) -> DataFrame:
    """A chunk for each outermost declaration of a file: its lines, kind and name.  Text outside of any belongs to no chunk."""
    importable(files.sparkSession)
    schema = pa.schema([("file", pa.string()), ("language", pa.string()), ("start_line", pa.int64()), ("end_line", pa.int64()), ("scope", pa.string()), ("content", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for f, lang, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                end, lines = 0, (c or "").split("\n")
                for s in sorted(parsing.parsed(c or "", lang or "")[0], key=lambda s: (s.start, -s.end)):
                    body = "\n".join(lines[s.start - 1 : s.end])
                    if s.start > end and body.strip():
                        rows.append({"file": f, "language": lang, "start_line": s.start, "end_line": s.end, "scope": f"{s.kind.lower()}::{s.name}", "content": body})
                        end = s.end
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.where(F.col(language).isin(*routed)).select(F.col(file), F.col(language), F.col(content)).mapInArrow(run, "file string, language string, start_line long, end_line long, scope string, content string")
