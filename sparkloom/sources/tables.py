"""The driver's tables, and sources of text and code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import rules, text

MAX_BYTES = 512 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(c: Column) -> Column:
    return F.regexp_replace(c, r"^file:/+", "/")


def tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """All files under root: path, relative path, bytes, time, content (read only by plans that name it).

    Spark's listing passes over names that begin with a dot or an underscore,
    and over empty files.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(root).withColumn("path", _path(F.col("path")))
    return df.withColumn("file", text.relative(F.col("path"), F.lit(root)))


def outside_skipped(file: Column, skip: tuple[str, ...] | list[str] = rules.SKIP_DIRS) -> Column:
    """No folder of the relative path is on the list."""
    return ~F.exists(F.slice(F.split(file, "/"), F.lit(1), F.size(F.split(file, "/")) - 1), lambda x: x.isin(*skip))


def ignored_by(spark: SparkSession, root: str) -> list[str]:
    """The patterns of the root's .gitignore, without negations: configuration, read on the driver through Hadoop's file system, since scans pass over dot-names."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.gitignore")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    stream = fs.open(path)
    try:
        body = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return [x.strip() for x in body.splitlines() if x.strip() and x.strip()[0] not in "#!"]


def not_ignored(file: Column, patterns: list[str]) -> Column:
    ok = F.lit(True)
    for p in patterns:
        anchored, body = p.startswith("/"), p.strip("/")
        if "/" in body or anchored:
            ok = ok & ~file.rlike(text.glob_regex(body)[:-1] + "(?:/.*)?$")
        else:
            ok = ok & ~F.exists(F.split(file, "/"), _matches(body))
    return ok


def _matches(glob: str):
    pattern = text.glob_regex(glob)
    return lambda x: x.rlike(pattern)


def project_files(spark: SparkSession, root: str) -> DataFrame:
    """Ignore rules and skip list applied, hidden files included, supported extensions only."""
    f = F.col("file")
    return tree(spark, root).where(outside_skipped(f) & not_ignored(f, ignored_by(spark, root)) & text.language(f).isNotNull()).withColumn("language", text.language(f))


def analyzer_files(spark: SparkSession, root: str) -> DataFrame:
    """Dot-names and the folders node_modules, target and vendor below the root are passed over."""
    f = F.col("file")
    skip = F.exists(F.split(f, "/"), lambda x: x.startswith(".") | x.isin("node_modules", "target", "vendor"))
    return tree(spark, root).where(~skip & text.language(f).isNotNull()).withColumn("language", text.language(f))


def language_files(spark: SparkSession, root: str, language: str | None = None) -> DataFrame:
    """All supported extensions (and h++), or one language's, without ignore rules."""
    lang = F.when(F.lower(F.col("file")).endswith(".h++"), "cpp").otherwise(text.language(F.col("file")))
    df = tree(spark, root).withColumn("language", lang).where("language IS NOT NULL")
    return df.where(F.col("language") == language) if language else df


def matching_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return tree(spark, root).where(text.matches_glob(F.col("file"), "**/" + glob))


def text_files(spark: SparkSession, root: str) -> DataFrame:
    """path, hash: files without a binary extension, of MAX_BYTES at most, without a zero byte; the length filter is pushed down."""
    ext = F.coalesce(text.extension(F.col("file")), F.lit(""))
    ok = tree(spark, root).where((F.col("length") <= MAX_BYTES) & ~ext.isin(*rules.BINARY_EXTENSIONS) & outside_skipped(F.col("file")))
    ok = ok.where(F.instr(F.decode("content", "ISO-8859-1"), "\0") == 0)
    return ok.select(F.col("file").alias("path"), F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("content"))


def source_files(files: DataFrame) -> DataFrame:
    """path, language, content, hash, size, modified; files of unknown extension are an error row's absence."""
    return files.select("path", text.language(F.col("path")).alias("language"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where("language IS NOT NULL")


COST = T.StructType([T.StructField("timestamp", T.LongType()), T.StructField("provider", T.StringType()), T.StructField("model", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("cost_usd", T.DoubleType())])


def cost_audit(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; those that aren't entries are dropped."""
    return spark.read.schema(COST).option("mode", "DROPMALFORMED").json(path)


#: Kinds of tags.
TAG_KINDS = {"function": "Function", "class": "Class", "struct": "Struct", "interface": "Interface", "enum": "Enum", "method": "Method", "variable": "Variable", "constant": "Constant", "module": "Module", "trait": "Trait"}


def tags(raw: DataFrame, line: str = "value") -> DataFrame:
    """Symbols from JSON lines (name, path, line, kind); others and unknown kinds are dropped; all are public."""
    t = F.from_json(F.col(line), "name string, path string, line bigint, kind string")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in TAG_KINDS.items() for x in kv]), F.lower(F.col("t.kind")))
    return raw.select(t.alias("t")).select(F.col("t.name").alias("name"), F.col("t.path").alias("file"), F.col("t.line").alias("start_line"), kind.alias("kind"), F.lit("Public").alias("visibility")).where("name IS NOT NULL AND kind IS NOT NULL")


def webhook_changes(payloads: DataFrame, body: str = "body", header: str = "changed_files") -> DataFrame:
    """The changed paths: the header's comma list if there is one, else what the commits added or modified."""
    commits = F.from_json(F.col(body), "commits array<struct<added:array<string>,modified:array<string>>>")["commits"]
    both = F.flatten(F.transform(commits, lambda c: F.array_union(F.coalesce(c["added"], F.array().cast("array<string>")), F.coalesce(c["modified"], F.array().cast("array<string>")))))
    listed = F.filter(F.transform(F.split(F.col(header), ","), lambda x: F.trim(x)), lambda x: x != "")
    return payloads.withColumn("path", F.explode(F.when(F.coalesce(F.col(header), F.lit("")) != "", listed).otherwise(both)))


def signed(body: Column, signature: Column, secret: str) -> Column:
    """HMAC-SHA256 of body under secret, as sha256=<hex>, from the hash's definition."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), F.encode(body, "UTF-8")), 256))
    return signature == F.concat(F.lit("sha256="), F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), inner), 256))


def submodules(raw: DataFrame, value: str = "value", order: str = "n") -> DataFrame:
    """name, path from .gitmodules lines in order: each path belongs to the last section before it."""
    from pyspark.sql import Window

    section = F.regexp_extract(value, r'^\s*\[submodule\s+"([^"]*)"\]', 1)
    path = F.regexp_extract(value, r"^\s*path\s*=\s*(.*?)\s*$", 1)
    name = F.last(F.when(section != "", section), ignorenulls=True).over(Window.partitionBy("file").orderBy(order))
    return raw.select("file", name.alias("name"), path.alias("path")).where("path != ''")


def manifest(path: str) -> dict:
    """A project manifest (TOML), read on the driver; empty if there is none or it can't be read."""
    import tomllib

    try:
        with open(path, "rb") as f:
            return tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError):
        return {}


#: Dimensions of embedding models whose name holds a part; the first part that it holds counts.
DIMENSIONS = {"nomic-embed-text": 768, "mxbai-embed-large": 1024, "text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "all-minilm": 384, "bge-large": 1024, "bge-small": 512, "e5-large": 1024, "e5-small": 384}


def known_dimensions(model: str) -> int | None:
    return next((n for part, n in DIMENSIONS.items() if part in model), None)


def embedded(df: DataFrame, provider, text_column: str = "text") -> DataFrame:
    """Adds embedding (array<float>) by provider(list of texts) -> list of vectors, a batch of Arrow rows at a time."""
    import pandas as pd

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in provider(texts.tolist())])

    return df.withColumn("embedding", embed(F.col(text_column)))
