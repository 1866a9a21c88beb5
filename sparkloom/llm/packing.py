"""Packing token sequences as a cutting-stock problem, by column generation.

Documents of more than SIZE tokens give whole sequences first; the rest of each,
and every shorter document, is one piece.  The plan depends on the histogram of
piece lengths alone, however many documents there are: lengths are rounded up to
at most CLASSES classes of whole units (of 8 tokens, or fewer where that would
lose more than LOSS), chosen to lose little.  The
linear program over patterns (multisets of classes that fit a sequence) starts
from one-class patterns; a knapsack dynamic program prices new columns by the
dual values until none helps, or the bound that the duals prove is near.
Patterns are rounded down; what is left over is filled greedily, longest first.
Pieces, ranked within their class, take the patterns' slots.

Pieces stay whole if the plan pads little (PADDING).  Otherwise a share of them,
by rank, is cut in two at the largest power of two, which gives the program
pieces to fill gaps with and others that fill sequences among themselves; the
least of the SHARES that suffices is taken.

One pass tokenises; its slim rows are written, with checksums for either case.
A piece's rank is its rank in its task plus the counts of the tasks before, so
nothing is sorted or gathered: the histogram (at most SIZE rows) reaches the
driver, the counts by task and length are joined back.  A last shuffle of slim
rows by sequence adds up the offsets; a sequence has SIZE pieces at most.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.batches import give_back, small_batches
from sparkloom.llm.common import table, written
from sparkloom.llm.stretches import CLOSING, TOGETHER, Stretches, regrouped

SIZE, END = 4096, 2
#: Classes of lengths, the padding that needs no more cutting, and the shares of pieces that may be cut.
CLASSES, PADDING, SHARES = 224, 0.01, (0.0, 1 / 8, 1.0)
#: Sizes of a unit, and the share of tokens that rounding up to whole units may lose.
UNITS, LOSS = (8, 4, 2), 0.004
#: New stretches that are encoded in one call.
JOINED = 512
#: The linear program ends when its value is this share above the bound that the prices prove.
GAP = 2e-3
#: The normaliser and the pre-tokeniser (as in a vocabulary's file) whose texts can be cut into stretches.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


class Tokens:
    """Ids by the tokenizers library.

    A normaliser and pre-tokeniser as above never join text across white space,
    nor a letter or digit with the ASCII punctuation after it, and end in lower
    case; so texts are lower-cased in A-Z, cut at ASCII white space and before
    closing punctuation, and each distinct stretch is encoded once.  Texts that
    may spell an added token are cut at white space alone.  With any other
    vocabulary every text is encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = sorted({t["content"].lower() for t in spec["added_tokens"]})
        first = (spec["pre_tokenizer"] or {}).get("pretokenizers", [None])[0]
        self.cuttable = spec["normalizer"] == NORMALIZER and first == SPLIT and not any(set(x) & set(" \t\n\r.,;:!?") for x in self.added)
        plain = [t for t in spec["added_tokens"] if t["special"] and not any(t[x] for x in ("single_word", "lstrip", "rstrip", "normalized"))]
        self.mark = (plain[0]["content"], plain[0]["id"]) if self.cuttable and plain else None
        self.stretches = Stretches(self._learn)

    def _learn(self, stretches: list[str]) -> list[bytes]:
        """A call of the library costs as much as a short stretch, so many are encoded as one text, with an added token between them.

        A call gets JOINED stretches at most, since its encodings take many times the memory of their ids.
        """
        if self.mark is None or any(x in s for s in stretches for x in self.added):
            lots = (stretches[k : k + JOINED] for k in range(0, len(stretches), JOINED))
            return [np.array(e.ids, "<u4").tobytes() for x in lots for e in self.model.encode_batch_fast(x, add_special_tokens=False)]
        mark, own = self.mark
        out = []
        for k in range(0, len(stretches), JOINED):
            ids = np.array(self.model.encode_batch_fast([mark.join(stretches[k : k + JOINED]) + mark], add_special_tokens=False)[0].ids, "<u4")
            data, start = ids.tobytes(), 0
            for end in (4 * np.nonzero(ids == own)[0]).tolist():
                out.append(data[start:end])
                start = end + 4
        return out

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit integers."""
        return self.ids_of(pa.array([text], pa.string()))[0].tobytes()

    def ids_of(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; together they are a few MB, or one long text, which is worked through in chunks."""
        if not self.cuttable:
            return [np.frombuffer(self._learn([t])[0], "<u4") for t in texts.to_pylist()]
        if len(texts) == 1 and len(text := texts[0].as_py()) > TOGETHER:
            return [np.concatenate([x for c in _chunks(text) for x in self._ids(pa.array([c], pa.string()))])]
        return self._ids(texts)

    def _ids(self, texts: pa.Array) -> list[np.ndarray]:
        low = pc.ascii_lower(texts)
        odd = np.zeros(len(texts), bool)
        for x in self.added:
            odd |= pc.match_substring(low, x).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self.stretches.ids(pc.ascii_split_whitespace(pc.replace_substring_regex(low, CLOSING, r"\1 \2\3")))
        out: list = [None] * len(texts)
        for some, cut in ((~odd, low), (odd, texts)):
            if some.any():
                own = cut.filter(pa.array(some))
                parts = pc.ascii_split_whitespace(own if cut is texts else pc.replace_substring_regex(own, CLOSING, r"\1 \2\3"))
                for k, x in zip(np.nonzero(some)[0].tolist(), self.stretches.ids(parts), strict=True):
                    out[k] = x
        return out


def _chunks(text: str) -> Iterator[str]:
    """Chunks of TOGETHER characters or fewer that end before a space; a longer stretch without one is one chunk."""
    at = 0
    while len(text) - at > TOGETHER:
        end = text.rfind(" ", at + 1, at + TOGETHER)
        if end < 0 and (end := text.find(" ", at + TOGETHER)) < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


@functools.lru_cache(maxsize=1)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def _best_pattern(lengths: np.ndarray, prices: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack of most price: dynamic program by item over all capacities."""
    best = np.zeros(size + 1)
    layers = [best]
    for length, price in zip(lengths.tolist(), prices.tolist(), strict=True):
        if price > 1e-12:
            rows = -(-(size + 1) // length)
            grid = np.full(rows * length, -np.inf)
            grid[: size + 1] = best
            lift = (np.arange(rows) * price)[:, None]
            best = (np.maximum.accumulate(grid.reshape(rows, length) - lift, axis=0) + lift).reshape(-1)[: size + 1]
        layers.append(best)
    left, pattern = int(np.argmax(best)), np.zeros(len(lengths))
    for i in range(len(lengths) - 1, -1, -1):
        while left >= lengths[i] and layers[i + 1][left] > layers[i][left] + 1e-12:
            pattern[i] += 1
            left -= int(lengths[i])
    return float(best.max()), pattern


def solve(histogram: dict[int, int], size: int = SIZE, rounds: int = 2500) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> pieces) and how often each is used; together they hold each length exactly as often as histogram says."""
    lengths = np.array(sorted((x for x in histogram if histogram[x]), reverse=True), dtype=np.int64)
    if not len(lengths):
        return []
    demand = np.array([histogram[int(x)] for x in lengths], dtype=float)
    base = np.diag((size // lengths).astype(float))
    inverse, used = np.diag(1 / base.diagonal()), demand / base.diagonal()
    bound, centre = 0.0, lengths / size
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        # Prices swing from round to round: price at a point between the best seen and these, and at these where that finds nothing.
        for trial in (0.7 * centre + 0.3 * prices, prices):
            value, pattern = _best_pattern(lengths, trial, size)
            if value > 0 and (reached := float(trial @ demand) / value) > bound:
                bound, centre = reached, trial / value
            if prices @ pattern > 1 + 1e-6:
                break
        if prices @ pattern <= 1 + 1e-6 or used.sum() <= bound * (1 + GAP):
            break
        column = inverse @ pattern
        can = column > 1e-9
        if not can.any():
            break
        steps = np.full(len(column), np.inf)
        steps[can] = used[can] / column[can]
        out = int(np.argmin(steps))
        used = np.maximum(used - steps[out] * column, 0)
        used[out] = steps[out]
        row = inverse[out] / column[out]
        inverse = inverse - np.outer(column, row)
        inverse[out] = row
        base[:, out] = pattern
    times = np.floor(used + 1e-9).astype(np.int64)
    plan = []
    left = demand.astype(np.int64)
    for j in np.nonzero(times)[0]:
        a = base[:, j].astype(np.int64)
        fits = min([int(times[j]), *(int(left[i] // a[i]) for i in np.nonzero(a)[0])])
        if fits > 0:
            left -= a * fits
            plan.append(({int(lengths[i]): int(a[i]) for i in np.nonzero(a)[0]}, fits))
    while left.any():
        room, a = size, np.zeros(len(lengths), np.int64)
        for i in np.nonzero(left)[0]:
            a[i] = min(int(left[i]), room // int(lengths[i]))
            room -= int(a[i] * lengths[i])
        fits = min(int(left[i] // a[i]) for i in np.nonzero(a)[0])
        left -= a * fits
        plan.append(({int(lengths[i]): int(a[i]) for i in np.nonzero(a)[0]}, fits))
    return plan


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: rows of (first rank, pieces a sequence, first sequence, offset of the first piece)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: Counter = Counter()
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            out.setdefault(length, []).append((seen[length], pattern[length], sequence, offset))
            seen[length] += pattern[length] * times
            offset += pattern[length] * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def unit_of(histogram: dict[int, int]) -> int:
    total = sum(n * k for n, k in histogram.items())
    return next((u for u in UNITS if sum((-n % u) * k for n, k in histogram.items()) <= LOSS * total), 1)


def classes(histogram: dict[int, int], size: int, most: int = CLASSES) -> np.ndarray:
    """Ascending class sizes: the powers of two up to size, and others that make rounding up lose the least.

    Each further bound is the one that saves the most within its interval.
    """
    count = np.zeros(size + 1, np.int64)
    for n, k in histogram.items():
        count[n] = k
    below = np.cumsum(count)
    bounds = [1 << k for k in range(size.bit_length()) if 1 << k <= size]

    def best(low: int, high: int) -> tuple[int, int, int, int]:
        if high - low < 2:
            return 0, 0, low, high
        inside = np.arange(low + 1, high)
        saved = (below[inside] - below[low]) * (high - inside)
        k = int(np.argmax(saved))
        return -int(saved[k]), int(inside[k]), low, high

    heap = [best(a, b) for a, b in zip([0, *bounds], bounds, strict=False)]
    heapq.heapify(heap)
    while len(bounds) < most and heap[0][0] < 0:
        _, mid, low, high = heapq.heappop(heap)
        bounds.append(mid)
        heapq.heappush(heap, best(low, mid))
        heapq.heappush(heap, best(mid, high))
    return np.array(sorted(bounds), np.int64)


def body(n):
    """Where a piece of n tokens is cut, if it is: the largest power of two up to n."""
    return 1 << (np.frexp(np.asarray(n, float))[1].astype(np.int64) - 1)


@dataclass(frozen=True)
class Plan:
    """By length: how many pieces (of least rank) are cut, the class (in units) of a piece so long, and where the ranks of whole pieces, bodies and rests begin in their class; slots by class; sequences."""

    cut: np.ndarray
    of: np.ndarray
    whole: np.ndarray
    body: np.ndarray
    rest: np.ndarray
    slots: dict[int, np.ndarray]
    sequences: int


def planned(histogram: dict[int, int], share: float, size: int = SIZE) -> Plan:
    """The plan with that share of the pieces of each length cut."""
    lengths = np.arange(size + 1)
    count = np.zeros(size + 1, np.int64)
    for n, k in histogram.items():
        count[n] = k
    bodies = np.concatenate(([0], body(lengths[1:])))
    cut = np.where(bodies < lengths, np.ceil(count * share), 0).astype(np.int64)
    items: Counter = Counter()
    starts = [np.zeros(size + 1, np.int64) for _ in range(3)]
    parts = [(int(n), int(bodies[n]), int(count[n] - cut[n]), int(cut[n])) for n in np.nonzero(count)[0]]
    for n, first, uncut, k in parts:
        items.update({n: uncut})
        items.update({first: k})
        items.update({n - first: k})
    unit = unit_of(items)
    rounded: Counter = Counter()
    for n, k in items.items():
        rounded[-(-n // unit)] += k
    bounds = classes(rounded, size // unit)
    of = np.concatenate(([0], bounds[np.searchsorted(bounds, -(-lengths[1:] // unit))]))
    demand: Counter = Counter()
    for n, first, uncut, k in parts:
        for start, length, pieces_ in zip(starts, (n, first, n - first), (uncut, k, k), strict=True):
            start[n] = demand[int(of[length])]
            demand[int(of[length])] += pieces_
    patterns = solve({x: k for x, k in demand.items() if k}, size // unit)
    return Plan(cut, of, *starts, slots(patterns), sum(n for _, n in patterns))


def plan(histogram: dict[int, int], size: int = SIZE) -> Plan:
    """The plan of the least share of cut pieces that pads little; if none does, the one with the fewest sequences."""
    least = sum(n * k for n, k in histogram.items()) / size
    best = None
    for share in SHARES:
        found = planned(histogram, share, size)
        if best is None or found.sequences < best.sequences:
            best = found
        if found.sequences <= least * (1 + PADDING) + 1:
            break
    return best


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in _PIECE.split(", ")])
_CUT = ("body_crc32", "rest_crc32", "rank")


def pieces(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The pieces of each whole text with END after it: whole sequences, then the rest, each with its rank among those of its length in its task.

    body_crc32 and rest_crc32 are the checksums of the two parts that a piece has if it is cut.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.spark_partition_id().alias("part"))
    end = np.array([END], "<u4")
    names = [*_SCHEMA.names, *_CUT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        t = tokens(path)
        try:
            for b in regrouped(batches, 1):
                rows = []
                for doc_id, ids in zip(b.column(0).to_pylist(), t.ids_of(b.column(1)), strict=True):
                    ids = np.concatenate((ids, end))
                    for at in range(0, len(ids), SIZE):
                        own = ids[at : at + SIZE]
                        mid = 1 << (len(own).bit_length() - 1)
                        first = zlib.crc32(own[:mid])
                        rows.append((doc_id, at, len(own), zlib.crc32(own[mid:], first), len(ids), first, zlib.crc32(own[mid:]), seen[len(own)]))
                        seen[len(own)] += 1
                for k in range(0, len(rows), 1 << 16):
                    columns = [pa.array(c, pa.int64()) for c in zip(*rows[k : k + (1 << 16)], strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(columns[0]), b.column(2)[0].as_py(), np.int32))], names=[*names, "part"])
        finally:  # the worker outlives the task
            t.stretches.forget()
            give_back()

    return d.mapInArrow(run, _PIECE + "".join(f", {c} long" for c in _CUT) + ", part int")


def _placed(p: Plan, c: dict[str, np.ndarray], doc_id: pa.Array) -> Iterator[pa.RecordBatch]:
    """The pieces of a batch in their sequences: the whole ones, the bodies of the cut ones, their rests.  slot orders a sequence's pieces."""
    n, rank = c["length"], c["rank"]
    mid = body(n)
    is_cut = rank < p.cut[n]
    for some, kind, at, start, length, crc in (
        (~is_cut, p.of[n], p.whole[n] + rank - p.cut[n], c["start"], n, c["ids_crc32"]),
        (is_cut, p.of[mid], p.body[n] + rank, c["start"], mid, c["body_crc32"]),
        (is_cut, p.of[n - mid], p.rest[n] + rank, c["start"] + mid, n - mid, c["rest_crc32"]),
    ):
        own = np.nonzero(some)[0]
        if len(own):
            sequence, slot = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            for x in np.unique(kind[own]):
                here = np.nonzero(kind[own] == x)[0]
                s = p.slots[int(x)]
                s = s[np.searchsorted(s[:, 0], at[own[here]], "right") - 1]
                inside = at[own[here]] - s[:, 0]
                sequence[here] = s[:, 2] + inside // s[:, 1]
                slot[here] = s[:, 3] + inside % s[:, 1] * x
            columns = (start, length, crc, c["doc_tokens"])
            yield pa.RecordBatch.from_arrays([doc_id.take(pa.array(own)), *(pa.array(x[own]) for x in columns), pa.array(sequence), pa.array(slot)], names=[*_SCHEMA.names, "sequence_id", "slot"])


def pack(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The pieces with sequence_id and offset; sequences hold SIZE tokens at most.

    Null text counts as empty: a document of the one token END.  Repeated rows
    are packed each; an empty table gives an empty result; other columns are
    dropped.
    """
    found = written(pieces(docs, path, text), "pieces")
    counts = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()})
    ranked = found.join(counts.select("part", "length", before.alias("before")), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    names = ("start", "length", "ids_crc32", "doc_tokens", *_CUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from _placed(p, {x: b.column(b.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in names}, b.column(0))

    placed = ranked.select("doc_id", *names).mapInArrow(run, _PIECE + ", sequence_id long, slot long")
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("slot")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
