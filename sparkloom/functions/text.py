"""Scalar functions on text and names, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import rules


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and _ of more than one byte."""
    return F.transform(F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda x: F.octet_length(x) > 1), F.lower)


def word_count(text: Column) -> Column:
    """White-space separated words; null counts as empty."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""))


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no line; empty text has none."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))


def line_at(text: Column, n: Column | int) -> Column:
    """The n-th line from 1, trimmed; 0 is the first; none: empty."""
    at = F.lit(n) if isinstance(n, int) else n
    return F.trim(F.coalesce(F.get(lines(text), F.greatest(at, F.lit(1)) - 1), F.lit("")))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def project_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 12)


def extension(path: Column) -> Column:
    """What follows the last dot of the last segment, in its own case; null without one or in a dot-name."""
    found = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    return F.when(found != "", found)


def language(path: Column) -> Column:
    ext, out = F.lower(extension(path)), F.lit(None).cast("string")
    for name, known in rules.EXTENSIONS.items():
        out = F.when(ext.isin(*known), name).otherwise(out)
    return out


def language_named(name: Column) -> Column:
    low, out = F.lower(name), F.lit(None).cast("string")
    for alias, of in {**{k: k for k in rules.EXTENSIONS}, **rules.ALIASES}.items():
        out = F.when(low == alias, of).otherwise(out)
    return out


def scrubbed(text: Column) -> Column:
    """Secrets replaced, each pattern on the result of the ones before."""
    for pattern, label in rules.SECRETS:
        text = F.regexp_replace(text, pattern, label)
    return text


def calls(text: Column) -> Column:
    """Names before an opening bracket, in order."""
    return F.regexp_extract_all(text, F.lit(rules.CALL), F.lit(1))


def imports(text: Column) -> Column:
    """Imported names: pattern by pattern, in order within each."""
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in rules.IMPORTS]))


def importance(kind: Column) -> Column:
    out = F.lit(0.5)
    for name, score in rules.IMPORTANCE.items():
        out = F.when(kind == name, score).otherwise(out)
    return out


def scope_name(kind: Column, name: Column) -> Column:
    """project, module, file; class::N, method::N, function::N."""
    return F.when(kind.isin("Project", "Module", "File"), F.lower(kind)).otherwise(F.concat(F.lower(kind), F.lit("::"), name))


def sanitized(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_"))


def file_size(n: Column) -> Column:
    """Bytes by steps of 1024 to one decimal."""
    out, units = F.lit("0 B"), ("B", "KB", "MB", "GB", "TB")
    for k, u in enumerate(units):
        out = F.when(n >= (1024**k if k else 1), F.format_string(f"%.1f {u}", n / float(1024**k))).otherwise(out)
    return out


def shortened(path: Column, n: int) -> Column:
    """The last n characters after an ellipsis, where path is longer."""
    return F.when(F.length(path) > n, F.concat(F.lit("…"), F.right(path, F.lit(n)))).otherwise(path)


def relative(path: Column, root: Column) -> Column:
    under = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, under), F.substring(path, F.length(under) + 1, F.length(path))).otherwise(path)


def absolute(path: Column, root: Column) -> Column:
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), path))


def cache_key(kind: str, *parts: Column) -> Column:
    """kind:part:part...; kinds are project, symbols, chunks, summaries, graph, search and context."""
    return F.concat_ws(":", F.lit(kind), *[p.cast("string") for p in parts])


def symbol_id(file: Column, name: Column, kind: Column) -> Column:
    return F.concat_ws("::", file, name, kind)


def node_id(project: Column, file: Column, name: Column) -> Column:
    return F.concat_ws(":", project, file, name)


def fingerprint(provider: Column, model: Column) -> Column:
    return F.concat_ws(":", provider, model)


def fallback_summary(content: Column, n_tokens: Column) -> Column:
    return F.concat(F.lit("Code chunk ("), n_tokens.cast("string"), F.lit(" tokens):\n"), F.array_join(F.slice(lines(content), 1, 5), "\n"))


def summary_prompt(content: Column, path: Column) -> Column:
    """Asks for a JSON summary with eight keys."""
    keys = "purpose, inputs, outputs, side_effects, dependencies, complexity, tags, notes"
    return F.concat(F.lit(f"Summarise this code as one JSON object with the keys {keys}.\nFile: "), path, F.lit("\n\n"), content)


def preview(content: Column) -> Column:
    """The first three lines that aren't blank, after the header line."""
    return F.slice(F.filter(F.slice(F.split(content, "\n"), 2, 1 << 30), lambda x: F.trim(x) != ""), 1, 3)


def glob_regex(glob: str) -> str:
    """A glob as an anchored regular expression: ** any path, * and ? within a segment, [..] and {a,b}."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
            continue
        if glob.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        if c == "[" and "]" in glob[k + 1 :]:
            end = glob.index("]", k + 1)
            body = glob[k + 1 : end]
            out, k = out + "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]", end + 1
            continue
        if c == "{" and "}" in glob[k + 1 :]:
            end = glob.index("}", k + 1)
            out, k = out + "(?:" + "|".join(re.escape(x) for x in glob[k + 1 : end].split(",")) + ")", end + 1
            continue
        out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), k + 1
    return f"^{out}$"


def matches_glob(path: Column, glob: str) -> Column:
    """The glob's literal beginning is also a prefix test, which scans can be given."""
    literal = re.match(r"[^*?\[{]*", glob)[0]
    hit = path.rlike(glob_regex(glob))
    return F.startswith(path, F.lit(literal)) & hit if literal else hit
