"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Over a window of five bytes, six triplets that hold the newest byte are hashed
into 256 buckets.  Each bucket is encoded in two bits by the quartile its count
falls into; a header holds the length's logarithm, the quartiles' ratios and a
checksum.  Two digests differ by the sum of their bucket codes' distances (the
extremes count double) and of their headers', bounded by what unrelated texts
differ by; the likeness is one less the bounded share.

A text meets its neighbour in descending order of ids by one range-partitioned
sort that streams through Python, holding two texts at a time.  The last text of
each partition finds its neighbour in a second, small step: two texts a
partition, joined by partition number.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.batches import gathered, rows_of, small_batches
from sparkloom.llm.common import table, written

BUCKETS = 256
#: The offsets of each triplet's second and third byte before the newest, and its odd multipliers.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
MULTIPLIERS = ((40503, 10007, 51803), (30011, 60013, 12289), (47293, 20011, 35051), (15013, 55001, 25013), (61001, 33013, 18013), (23017, 44017, 58013))
#: What the bucket codes of unrelated texts differ by on average, and the most that is told apart.
CAP = 1.625 * BUCKETS


def counts(data: bytes) -> np.ndarray:
    """How often each bucket is hit."""
    b = np.frombuffer(data, np.uint8).astype(np.uint16)
    total = np.zeros(BUCKETS, np.int64)
    for (i, j), (x, y, z) in zip(TRIPLETS, MULTIPLIERS, strict=True):
        if len(b) > j:
            h = b[j:] * np.uint16(x) + b[j - i : len(b) - i] * np.uint16(y) + b[: len(b) - j] * np.uint16(z)
            h ^= h >> np.uint16(7)
            total += np.bincount((h * np.uint16(40503)) >> np.uint16(8), minlength=BUCKETS)
    return total


class Digest:
    """code: the quartile of each bucket, 0 to 3; header: length, ratios of quartiles, checksum."""

    __slots__ = ("code", "header")

    def __init__(self, data: bytes):
        c = counts(data)
        q1, q2, q3 = np.partition(c, (63, 127, 191))[[63, 127, 191]]
        self.code = (c > q1).astype(np.uint8) + (c > q2) + (c > q3)
        size = min(255, int(math.log(len(data), 1.1))) if data else 0
        ratio = lambda q: int(q * 15 // q3) if q3 else 0
        self.header = (size, ratio(q1), ratio(q2), hashlib.blake2b(data, digest_size=1).digest()[0])

    def text(self) -> str:
        c = self.code.reshape(-1, 4)
        size, a, b, check = self.header
        return f"Q1{check:02x}{size:02x}{a:x}{b:x}" + (c[:, 0] << 6 | c[:, 1] << 4 | c[:, 2] << 2 | c[:, 3]).tobytes().hex()


def parsed(text: str) -> Digest:
    """The digest that text() wrote."""
    d = Digest.__new__(Digest)
    d.header = (int(text[4:6], 16), int(text[6], 16), int(text[7], 16), int(text[2:4], 16))
    b = np.frombuffer(bytes.fromhex(text[8:]), np.uint8)
    d.code = np.stack([b >> 6, b >> 4 & 3, b >> 2 & 3, b & 3], axis=1).reshape(-1)
    return d


def difference(a: Digest, b: Digest) -> float:
    """0 for equal digests; at most CAP."""
    gap = np.abs(a.code.astype(np.int8) - b.code.astype(np.int8))
    body = int(gap.sum()) + 3 * int((gap == 3).sum())
    head = max(0, abs(a.header[0] - b.header[0]) - 1) + abs(a.header[1] - b.header[1]) + abs(a.header[2] - b.header[2]) + (a.header[3] != b.header[3])
    return min(CAP, float(body + head))


def likeness(a: Digest, b: Digest) -> float:
    return 1 - difference(a, b) / CAP


def digests(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep's columns and fingerprint for each row, without a shuffle.  Null text counts as empty."""
    small_batches(docs.sparkSession)
    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([Digest(t.as_py().encode()).text() for t in b.column(len(keep))], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), found], names=[*keep, "fingerprint"])

    return d.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != "_text"] + ["fingerprint string"]))


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGES = _OUT + ", part int, edge string, text string"
_ARROW = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _pair(doc_id: int | None, text: str, own: Digest, after: str, other: Digest) -> tuple:
    n = len(text)
    edited = (text[: n - n // 3] + after[: n // 3]).encode()
    e = Digest(edited)
    return doc_id, n, hashlib.sha256(edited).hexdigest(), own.text(), e.text(), likeness(own, e), likeness(own, other)


def edited_by_next(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint beside that of its edit by the next text in descending order of doc_id.

    Null texts count as empty.  Rows of one doc_id follow each other by text;
    null ids come last.  A table of one row is its own neighbour; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = (F.col("doc_id").desc_nulls_last(), F.col("text"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.repartitionByRange(n, F.col("doc_id").desc_nulls_last()).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
    schema = pa.schema([*_ARROW, ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        before = None
        for doc_id, text, part in rows_of(batches, "doc_id", "text", "part"):
            own = Digest(text.encode())
            if before is None:
                yield doc_id, None, None, None, None, None, None, part, "first", text
            else:
                yield *_pair(*before[:3], text, own), part, None, None
            before = doc_id, text, own, part
        if before:
            yield before[0], None, None, None, None, None, None, before[3], "last", before[1]

    run = lambda batches: gathered(stream(batches), schema, lambda r: len(r[9] or ""))
    all_rows = written(d.mapInArrow(run, _EDGES), "fingerprints")
    edges = all_rows.where("edge IS NOT NULL").select("part", "edge", "doc_id", "text")
    parts = edges.where("edge = 'last'").select("part")  # a row a partition
    order = Window.orderBy("part")
    follows = parts.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("then"))
    first = edges.where("edge = 'first'").select(F.col("part").alias("then"), F.col("text").alias("after"))
    open_ = edges.where("edge = 'last'").join(follows, "part").join(first, "then").select("doc_id", "text", "after")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (_pair(i, t, Digest(t.encode()), a, Digest(a.encode())) for i, t, a in rows_of(batches, "doc_id", "text", "after"))
        return gathered(rows, pa.schema(_ARROW))

    return all_rows.where("edge IS NULL").select(*(x for x, _ in _ARROW)).unionByName(open_.mapInArrow(close, _OUT))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_by_next(table(spark, sf_dir, "documents"))
