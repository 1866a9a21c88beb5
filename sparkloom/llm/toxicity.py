"""Toxic passages by maximum-scoring segments of token log-odds.

Each word has the log-odds of standing in a toxic rather than a clean labelled
document (counted once a document; a rare word has its stem's), under Dirichlet priors in proportion to the classes' sizes, less a
drift that makes ordinary text score below zero.  A linear scan finds every
maximal scoring segment of a text (Ruzzo and Tompa).  Segment scores are judged
by the extreme-value law of such maxima, P(S >= x) = 1 - exp(-K n exp(-lambda x)):
lambda solves the moment equation of clean text, K is fitted on clean documents.
A document's segments are aggregated by their normalised scores, which a
logistic calibration turns into a probability.

Learning reads a bounded sample of labelled rows (SAMPLE, the rows of least hash)
that lie outside the held-out fold: three folds for the log-odds, one for the
calibration.  The sample's ids have a fixed size, so they are broadcast and no
text is shuffled; the sample is written and read again.  Counts are pre-aggregated
by task.  The model holds every word and stem whose weight is SURE standard
deviations or more from zero; there are no more of them than the sample has words
that occur LEAST times.  Scoring is row-local over whole texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.batches import gathered, rows_of, small_batches
from sparkloom.llm.common import table, written

#: Labelled rows to learn from, pseudo-counts, drift, standard deviations of a weight that tells, distinct words a task counts before it hands them on.
SAMPLE, PRIOR, DRIFT, SURE, COUNTED = 32_768, 10.0, 1.0, 1.0, 1 << 18
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Bytes of a word's stem; words that are too rare for a weight of their own take their stem's.
STEM, LEAST = 5, 5
_FEATURES = "best double, total double, n_significant double"


@dataclass(frozen=True)
class Model:
    weights: dict[bytes, float]
    rest: float
    lam: float
    k: float
    #: Of the intercept and the features.
    beta: tuple[float, ...]


def tokens(text: str) -> list[bytes]:
    """Words in lower case (A-Z), without ASCII punctuation."""
    return text.encode().translate(_FOLDED).split()


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), left to right, in linear time."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum at the end
    # For each candidate, the nearest earlier one with a smaller sum before it.
    back: list[int] = []
    total, k, n = 0.0, 0, len(scores)
    while k < n:
        x = scores[k]
        if x <= 0:
            total += x
            k += 1
            continue
        start, left, right = k, total, total + x
        total, k = right, k + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = back[j]
            if j < 0 or found[j][3] >= right:
                found.append((start, k, left, right))
                back.append(j)
                break
            start, left = found[j][0], found[j][2]
            del found[j:], back[j:]
    return [(a, b, r - s) for a, b, s, r in found]


def counted(text: str) -> set[bytes]:
    """What a document is counted under: its words, and the stems (after a zero byte) of its longer words."""
    words = set(tokens(text))
    return words | {b"\0" + w[:STEM] for w in words if len(w) > STEM}


class Weights(dict):
    """Word -> score, filled from the model as words come up; at most HELD words are kept."""

    HELD = 1 << 19

    def __init__(self, listed: dict[bytes, float]):
        super().__init__()
        self.listed = listed

    def __missing__(self, w: bytes) -> float | None:
        if len(self) >= self.HELD:
            self.clear()
        found = self[w] = self.listed.get(w, self.listed.get(b"\0" + w[:STEM]) if len(w) > STEM else None)
        return found


def _segments_of(words: list[bytes], weights: Weights, rest: float) -> list[tuple[int, int, float]]:
    """segments() of the words' scores; stretches without a listed word are passed over as one."""
    score = [weights[w] for w in words]
    at = [k for k, x in enumerate(score) if x is not None]
    if not at:
        return []
    runs, place, end = [], [], 0
    for k in at:
        if k > end:
            runs.append(rest * (k - end))
            place.append(end)
        runs.append(score[k])
        place.append(k)
        end = k + 1
    place.append(end)
    return [(place[a], place[b - 1] + 1, s) for a, b, s in segments(runs)]


def features(found: list[tuple[int, int, float]], n: int, lam: float, k: float) -> tuple[float, float, float]:
    """From the normalised scores lambda S - ln(K n) of a text's segments: the best, the sum of the positive ones, their number, each on a log scale."""
    least = math.log(max(k, 1e-12) * max(n, 1))
    up = [x for _, _, s in found if (x := lam * s - least) > 0]
    return (math.log1p(max(up, default=0.0)), math.log1p(sum(up)), math.log1p(len(up)))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, fold) of the sample; the broadcast side has SAMPLE rows at most."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("_toxic"), fold(F.col("doc_id")).alias("_fold"))
    known = known.where("_fold != 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).dropDuplicates(["doc_id"])
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").select("text", "_toxic", "_fold")


def _lambda(weights: np.ndarray, shares: np.ndarray, rest: float) -> float:
    """The positive root of sum p exp(lambda s) = 1 over clean text."""
    value = lambda x: float((shares * np.exp(x * weights)).sum() + max(0.0, 1 - shares.sum()) * math.exp(x * rest)) - 1
    low, high = 1e-3, 1.0
    while value(high) < 0 and high < 16:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method; classes weigh as they occur."""
    x = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labels (doc_id, toxic) outside the held-out fold.

    Without labels of both classes the model scores every text alike, as the one
    class there is (clean without any label).  If the calibration fold lacks a
    class, nothing can be calibrated: a text with a significant passage is toxic
    (a fixed beta), one without is not.  Null texts count as empty, null labels
    and ids teach nothing, repeated labels count once, repeated rows each.
    """
    small_batches(docs.sparkSession)
    known = written(_sampled(docs, labels), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.binary()), ("clean", pa.int64()), ("toxic", pa.int64())])
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> Iterator[tuple]:
            for w in held[0].keys() | held[1].keys():
                yield w, held[0][w], held[1][w]
            held[0].clear()
            held[1].clear()

        def rows() -> Iterator[tuple]:
            for text, toxic in rows_of(batches, "text", "_toxic"):
                held[toxic > 0].update(counted(text))
                if len(held[0]) + len(held[1]) > COUNTED:
                    yield from flush()
            yield from flush()

        return gathered(rows(), schema)

    sums = known.where("_fold != 4").mapInArrow(count, "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).persist()
    try:
        n0, n1 = sums.agg(F.sum("clean"), F.sum("toxic")).first()
        if not n0 or not n1:
            return Model({}, -DRIFT, 1.0, 1.0, (-30.0 if not n1 else 30.0, 0.0, 0.0, 0.0))
        ratio = n0 / n1
        # Class-proportional pseudo-counts; a word's lean the way of its stem's odds.
        odds = lambda lean: F.log((F.col("toxic") + PRIOR * F.exp(lean / 2)) / (F.col("clean") / ratio + PRIOR * F.exp(-lean / 2)))
        stemmed = F.substring("word", 1, 1) == F.lit(b"\0")
        stems = sums.where(stemmed).select(F.expr(f"substring(word, 2, {STEM})").alias("stem"), odds(F.lit(0.0)).alias("lean"))
        words = sums.where(~stemmed).withColumn("stem", F.expr(f"CASE WHEN length(word) > {STEM} THEN substring(word, 1, {STEM}) END")).join(stems, "stem", "left")
        w = words.select("word", "clean", "toxic", odds(F.coalesce("lean", F.lit(0.0))).alias("w")).unionByName(sums.where(stemmed).select("word", "clean", "toxic", odds(F.lit(0.0)).alias("w")))
        deviation = F.sqrt(1 / (F.col("toxic") + PRIOR) + 1 / (F.col("clean") / ratio + PRIOR))
        rows = w.where(F.col("toxic") + F.col("clean") >= LEAST).where(F.abs("w") >= SURE * deviation).orderBy("word").collect()
    finally:
        sums.unpersist()
    weights = {bytes(r["word"]): r["w"] - DRIFT for r in rows}
    lam = _lambda(np.array([r["w"] - DRIFT for r in rows]), np.array([r["clean"] / n0 for r in rows]), -DRIFT)

    def measure(k: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = Weights(weights)
            schema = pa.schema([("toxic", pa.int32()), ("best", pa.float64()), ("n", pa.int64()), *((x.split()[0] + "_", pa.float64()) for x in _FEATURES.split(", "))])

            def rows() -> Iterator[tuple]:
                for text, toxic in rows_of(batches, "text", "_toxic"):
                    words = tokens(text)
                    found = _segments_of(words, of, -DRIFT)
                    yield toxic, max((s for _, _, s in found), default=0.0), len(words), *features(found, len(words), lam, k)

            return gathered(rows(), schema)

        return known.where("_fold = 4").mapInArrow(run, "toxic int, best double, n long, best_ double, total_ double, n_significant_ double").toPandas()

    seen = measure(1.0)
    clean = seen[(seen.toxic == 0) & (seen.n > 0)]
    k = math.log(2) * math.exp(float(np.median(lam * clean.best - np.log(clean.n)))) if len(clean) else 1.0
    # K only shifts the normalised scores, so they are derived anew from a second, equally small pass.
    seen = measure(k)
    y = (seen.toxic > 0).to_numpy(float)
    if not 0 < y.sum() < len(y):
        return Model(weights, -DRIFT, lam, k, (-1.0, 1.0, 0.0, 0.0))
    beta = _logistic(seen[["best_", "total_", "n_significant_"]].to_numpy(float), y)
    return Model(weights, -DRIFT, lam, k, tuple(float(b) for b in beta))


def passages(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep's columns, score (0 to 1) and passages: the significant segments (first and last word from 0, score, P-value) of each whole text.

    Null and empty texts have no passages and the score of a text without any.
    Repeated rows score alike; an empty table gives an empty result; columns
    that aren't in keep are dropped, as are its columns named like a result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = tuple(k for k in keep if k not in ("score", "passages"))
    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    shared = spark.sparkContext.broadcast(model)
    item = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("p", pa.float64())])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != "_text"] + ["score double", "passages array<struct<first:bigint,last:bigint,score:double,p:double>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        of = Weights(m.weights)
        for b in batches:
            scores, spans = [], []
            for t in b.column(len(keep)):
                words = tokens(t.as_py())
                n = len(words)
                found = _segments_of(words, of, m.rest)
                x = (1.0, *features(found, n, m.lam, m.k))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * c for a, c in zip(m.beta, x, strict=True)))))))
                judged = ((a, e, s, -math.expm1(-m.k * n * math.exp(-m.lam * s))) for a, e, s in found)
                spans.append([{"first": a, "last": e - 1, "score": s, "p": p} for a, e, s, p in judged if p < 0.05])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(item))], names=[*keep, "score", "passages"])

    return d.mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = passages(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
