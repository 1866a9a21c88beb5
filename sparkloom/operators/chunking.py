"""Chunkers: one row of text to many, by lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text


def windows(df: DataFrame, path: str, content: str, size: int = 60, overlap: int = 10) -> DataFrame:
    """Windows of size lines that overlap; 1-based inclusive lines; blank windows are dropped; content opens with a // path line."""
    step = size - overlap
    d = df.withColumn("_lines", text.lines(F.col(content))).where(F.size("_lines") > 0)
    starts = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1, F.lit(step)), lambda s: (s == 0) | (s - step + size < F.size("_lines")))
    d = d.withColumn("_start", F.explode(starts)).withColumn("_part", F.slice("_lines", F.col("_start") + 1, F.lit(size)))
    d = d.where(F.exists("_part", lambda x: F.trim(x) != ""))
    d = d.withColumn("start_line", F.col("_start") + 1).withColumn("end_line", F.col("_start") + F.size("_part"))
    return d.withColumn("chunk", F.concat(F.lit("// "), F.col(path), F.lit("\n"), F.array_join("_part", "\n"))).drop("_lines", "_start", "_part")


def by_lines(df: DataFrame, content: str, max_tokens: int = 512) -> DataFrame:
    """Runs of max_tokens / 10 lines (at least one): chunk_no, start and end line (1-based inclusive), start and end byte, token_count."""
    n = max(1, max_tokens // 10)
    d = df.withColumn("_lines", text.lines(F.col(content))).where(F.size("_lines") > 0)
    d = d.select(*df.columns, "_lines", F.posexplode(F.sequence(F.lit(0), F.size("_lines") - 1, F.lit(n))).alias("chunk_no", "_start"))
    bytes_of = lambda a: F.octet_length(F.array_join(a, "\n"))
    d = d.withColumn("_part", F.slice("_lines", F.col("_start") + 1, F.lit(n)))
    d = d.withColumn("start_byte", F.when(F.col("_start") == 0, 0).otherwise(bytes_of(F.slice("_lines", F.lit(1), F.greatest(F.col("_start"), F.lit(1)))) + 1).cast("long"))
    d = d.withColumns({"chunk": F.array_join("_part", "\n"), "start_line": F.col("_start") + 1, "end_line": F.col("_start") + F.size("_part"), "end_byte": F.col("start_byte") + bytes_of("_part")})
    return d.withColumn("token_count", text.word_count(F.col("chunk"))).drop("_lines", "_start", "_part")


def compat_lines(chunks: DataFrame, base: str = "core") -> DataFrame:
    """The line numbers of chunks as other readers count them: core is 0-based and half-open; fallback is 1-based and ends one past."""
    if base == "core":
        return chunks.withColumn("start_line", F.col("start_line") - 1)
    return chunks.withColumn("end_line", F.col("end_line") + 1)


def with_overlap(chunks: DataFrame, file: str, order: str = "chunk_no", words: int = 64) -> DataFrame:
    """Each chunk with the last words of the one before it in front; core_token_count is the count without them."""
    before = F.lag("chunk").over(Window.partitionBy(file).orderBy(order))
    w = F.filter(F.split(before, r"\s+"), lambda x: x != "")
    tail = F.array_join(F.slice(w, F.greatest(F.size(w) - words + 1, F.lit(1)), F.lit(words)), " ")
    d = chunks.withColumnRenamed("token_count", "core_token_count").withColumn("_tail", F.when(before.isNotNull(), tail))
    d = d.withColumn("chunk", F.when(F.coalesce(F.col("_tail"), F.lit("")) != "", F.concat("_tail", F.lit(" "), "chunk")).otherwise(F.col("chunk"))).drop("_tail")
    return d.withColumn("token_count", text.word_count(F.col("chunk")))


def with_tail(chunks: DataFrame, file: str, order: str = "chunk_no", overlap: int = 64) -> DataFrame:
    """Each chunk with the last 4 * overlap characters of the one before it and a line end in front."""
    before = F.lag("chunk").over(Window.partitionBy(file).orderBy(order))
    return chunks.withColumn("chunk", F.when(before.isNotNull(), F.concat(F.right(before, F.lit(4 * overlap)), F.lit("\n"), "chunk")).otherwise(F.col("chunk")))


def packed(lines: Column, limit: int) -> Column:
    """Greedy packing: lines are gathered until adding one (and its line end) would reach the limit; array of texts."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"), F.lit(False).alias("any"))

    def step(a: Column, x: Column) -> Column:
        full = a["any"] & (F.octet_length(a["held"]) + F.octet_length(x) + 2 > limit)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["held"]))).otherwise(a["done"]).alias("done"),
            F.when(full | ~a["any"], x).otherwise(F.concat(a["held"], F.lit("\n"), x)).alias("held"),
            F.lit(True).alias("any"),
        )

    return F.aggregate(lines, start, step, lambda a: F.when(a["any"], F.concat(a["done"], F.array(a["held"]))).otherwise(a["done"]))


def refined(df: DataFrame, content: str, max_tokens: int = 512) -> DataFrame:
    """Chunks over 4 * max_tokens bytes are split by lines, packed greedily; smaller ones stay."""
    limit = 4 * max_tokens
    parts = F.when(F.octet_length(content) > limit, packed(F.split(content, "\n"), limit)).otherwise(F.array(content))
    return df.select(*[c for c in df.columns if c != content], F.posexplode(parts).alias("part", content))


def stats(chunks: DataFrame, count: str = "token_count") -> DataFrame:
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return chunks.agg(F.count("*").alias("n_chunks"), z(F.sum(count)).alias("total"), z(F.expr(f"sum({count}) div count(*)")).alias("average"), z(F.max(count)).alias("most"), z(F.min(count)).alias("least"))


def overlapping(chunks: DataFrame, file: str, bucket: int = 4096) -> DataFrame:
    """Pairs of chunks of a file whose byte ranges intersect, with the first's share; joined by file and byte bucket, so a long file is many keys."""
    span = F.sequence(F.floor(F.col("start_byte") / bucket), F.floor(F.greatest(F.col("end_byte") - 1, F.col("start_byte")) / bucket))
    e = chunks.select(F.col(file).alias("_f"), "chunk_id", "start_byte", "end_byte", F.explode(span).alias("_b"))
    a, b = e.alias("a"), e.alias("b")
    hit = (F.col("a._f") == F.col("b._f")) & (F.col("a._b") == F.col("b._b")) & (F.col("a.chunk_id") < F.col("b.chunk_id")) & (F.col("a.start_byte") < F.col("b.end_byte")) & (F.col("b.start_byte") < F.col("a.end_byte"))
    # Each pair once: in the bucket where the intersection begins.
    once = F.floor(F.greatest("a.start_byte", "b.start_byte") / bucket) == F.col("a._b")
    both = F.least("a.end_byte", "b.end_byte") - F.greatest("a.start_byte", "b.start_byte")
    return a.join(b, hit & once).select(F.col("a._f").alias(file), F.col("a.chunk_id").alias("a"), F.col("b.chunk_id").alias("b"), F.round(both / (F.col("a.end_byte") - F.col("a.start_byte")), 6).alias("fraction"))


def chunk_id(project: Column, file: Column, first: Column, last: Column, no: Column) -> Column:
    return F.sha2(F.concat_ws(":", project, file, first.cast("string"), last.cast("string"), no.cast("string")), 256)


def matching(chunks: DataFrame, file: str = "file", language: str | None = None, glob: str | None = None, scope: str | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Chunks that meet all the conditions given."""
    if language:
        chunks = chunks.where(text.language(F.col(file)) == language)
    if glob:
        chunks = chunks.where(text.matches_glob(F.col(file), glob))
    if scope:
        chunks = chunks.where(F.col("scope") == scope)
    if low is not None:
        chunks = chunks.where(F.col("token_count") >= low)
    if high is not None:
        chunks = chunks.where(F.col("token_count") <= high)
    return chunks
