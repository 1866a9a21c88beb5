"""MinHash near-dedup: fast similarity sketches, banding, exact verification, connected components.

1. One pass makes each text's sketch (``minhash``); slim rows (id, set size, key
   of the set, band hashes) are written.
2. Texts with equal sets collapse into a class, represented by its smallest id,
   by a map-side combined aggregate: thousands of copies are one row from here.
3. Classes that share a band meet at the band's pivot, its smallest id (an
   aggregate and a join; the aggregate's side has one row a band, so AQE splits
   a hot band).  At the threshold a pair shares no band with a probability of
   (1 - 0.75**4)**36, 1e-6.
4. Each class is compared with its pivots on full shingle sets: a row of text a
   pair, streamed, with one set and its pivot's in memory.  A hot pivot is dealt
   in parts by the count of its bands.  Links to pivots make components.
5. Where a group has members that its pivot isn't similar to, pairs of different
   components remain.  Digests of the sketches (SLOTS bytes a class, blocks of
   BLOCK, each pair of blocks a unit) tell which classes may have such a partner:
   at the threshold 108 of 144 slots agree, with a deviation of 5.2, so a pair has
   fewer than LEAST with a probability of 4e-6.  Only those classes' texts meet in units of bounded bytes that find a
   spanning forest of their exact similarity graph.  No pair is ever a row.
6. Links between classes become components by alternating large and small stars,
   each step written to the shared folder; every row then looks up its class.

A group of k similar texts costs k rows of text; one of k unlike texts that share
a band costs k * ceil(k / BLOCK) rows of digests.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import minhash
from sparkloom.llm.batches import gathered, rows_of, small_batches
from sparkloom.llm.common import maybe, table, written

BLOCK, PERCENT = 1024, 75
#: Slots in which the digests of a pair agree that is compared exactly; bytes of the sets in a unit of exact comparison.
LEAST, BYTES = 84, 32 << 20


_SIGNATURE = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key, bands and sketch (its digest) for each row; the last three are null without words."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, keys, bands, digests = [], [], [], []
            for t in b.column(1):
                e = minhash.shingles(t.as_py())
                sizes.append(len(e))
                s = minhash.sketch(e) if len(e) else None
                keys.append(minhash.set_key(e) if len(e) else None)
                bands.append(minhash.bands(s) if len(e) else None)
                digests.append(minhash.digest(s) if len(e) else None)
            columns = (b.column(0), sizes, keys, bands, digests)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SIGNATURE.types, strict=True)], schema=_SIGNATURE)

    return d.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary")


def forest(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Edges (i, j) of a spanning forest of the sets' similarity graph: each set is compared with all that aren't reached yet."""
    n = len(sets)
    if n == 2:
        return [(0, 1)] if minhash.similar(*sets, percent) else []
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    flag = np.zeros(int(codes.max()) + 1, bool)
    left = np.arange(n)
    edges = []
    # The tokens of the sets not reached yet; made anew when half of them are.
    live, at = codes, starts
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            x = reached.pop()
            own = codes[starts[x] : starts[x] + sizes[x]]
            if len(live) > 2 * sizes[left].sum():
                live = np.concatenate([codes[starts[i] : starts[i] + sizes[i]] for i in left.tolist()])
                where = left
                at = np.concatenate(([0], np.cumsum(sizes[where])[:-1]))
            elif live is codes:
                where = np.arange(n)
            flag[own] = True
            both = np.add.reduceat(flag[live], at, dtype=np.int64)
            flag[own] = False
            ok = where[100 * both >= percent * (sizes[where] + sizes[x] - both)]
            new = np.intersect1d(ok, left, assume_unique=True)
            if len(new):
                edges += [(x, int(i)) for i in new]
                reached += new.tolist()
                left = np.setdiff1d(left, new, assume_unique=True)
    return edges


def _texts(docs: DataFrame, text: str, ids: DataFrame) -> DataFrame:
    """doc_id and text of ids' documents, or of few more: most are in no group, and a map of bounded size keeps them out of the shuffle."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return maybe(texts, "doc_id", ids, "_maybe", ids.count()).where("_maybe").drop("_maybe")


def _dealt(units: DataFrame, *keys: str) -> DataFrame:
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(n, *keys).sortWithinPartitions(*keys, "doc_id")


def _paired(members: DataFrame, n_blocks: str) -> DataFrame:
    """A row for each pair of blocks that a member's block is in: low, high."""
    m = members.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col(n_blocks)).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(n_blocks).cast("int") - 1)))
    return m.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("own", "other", n_blocks)


def verified(stars: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(pivot, rep, linked) for each of stars (pivot, rep, n) but the pivots' own: whether the two are similar."""
    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    # A pivot's own row has its largest n: its text goes to every part, each member's to one.
    parts = F.when(F.col("pivot") == F.col("rep"), F.sequence(F.lit(0), n_blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), n_blocks).cast("int")))
    members = stars.select(F.col("rep").alias("doc_id"), "pivot", F.explode(parts).alias("block"))
    units = _texts(docs, text, stars.select(F.col("rep").alias("doc_id"))).join(members.hint("merge"), "doc_id")
    units = _dealt(units.select("pivot", "block", "doc_id", "text"), "pivot", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            # The pivot has the least id, so it comes first; one id may have several texts.
            for (pivot, _), unit in itertools.groupby(rows_of(batches, "pivot", "block", "doc_id", "text"), lambda r: r[:2]):
                centre: list[np.ndarray] = []
                for *_, doc_id, said in unit:
                    e = minhash.shingles(said)
                    if doc_id == pivot:
                        centre.append(e)
                    else:
                        yield pivot, doc_id, any(minhash.similar(c, e) for c in centre if len(c) and len(e))

        return gathered(rows(), pa.schema([("pivot", pa.int64()), ("rep", pa.int64()), ("linked", pa.bool_())]))

    return units.mapInArrow(run, "pivot long, rep long, linked boolean")


def partnered(members: DataFrame, reps: DataFrame) -> DataFrame:
    """(pivot, doc_id) of the members (pivot, doc_id, comp, n_blocks) that may be similar to one of another component."""
    sketches = reps.select(F.col("rep").alias("doc_id"), "sketch")
    units = _dealt(_paired(members, "n_blocks").join(sketches, "doc_id").select("pivot", "low", "high", "doc_id", "comp", "sketch"), "pivot", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (pivot, *_), unit in itertools.groupby(rows_of(batches, "pivot", "low", "high", "doc_id", "comp", "sketch"), lambda r: r[:3]):
                ids, comps, sketches_ = zip(*(r[3:] for r in unit), strict=True)
                comp = np.array(comps)
                if (comp == comp[0]).all():
                    continue
                slots = np.frombuffer(b"".join(sketches_), np.uint8).reshape(len(ids), -1)
                for i, own in enumerate(slots):
                    agree = (slots == own).sum(axis=1)
                    if (agree[comp != comp[i]] >= LEAST).any():
                        yield pivot, ids[i]

        return gathered(rows(), pa.schema([("pivot", pa.int64()), ("doc_id", pa.int64())]))

    return units.mapInArrow(run, "pivot long, doc_id long").distinct()


def forests(members: DataFrame, reps: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(src, dst) that connect the members (pivot, doc_id) of each group as their exact similarity graph does."""
    sized = members.join(reps.groupBy(F.col("rep").alias("doc_id")).agg(F.sum("n_shingles").alias("size")), "doc_id")
    n = sized.groupBy("pivot").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") * 8 / BYTES)).alias("n_blocks"))
    units = _texts(docs, text, members.select("doc_id")).join(_paired(members.join(n, "pivot"), "n_blocks").hint("merge"), "doc_id")
    units = _dealt(units.select("pivot", "low", "high", "doc_id", "text"), "pivot", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, unit in itertools.groupby(rows_of(batches, "pivot", "low", "high", "doc_id", "text"), lambda r: r[:3]):
                ids, sets = [], []
                for *_, doc_id, said in unit:
                    e = minhash.shingles(said)
                    if len(e):
                        ids.append(doc_id)
                        sets.append(e)
                if len(ids) > 1:
                    yield from ((max(ids[i], ids[j]), min(ids[i], ids[j])) for i, j in forest(sets) if ids[i] != ids[j])

        return gathered(rows(), pa.schema([("src", pa.int64()), ("dst", pa.int64())]))

    return units.mapInArrow(run, "src long, dst long")


def linked(reps: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(node, component) of the classes (rep, bands, n_shingles, sketch) that are similar to another, directly or by others."""
    band = reps.select("rep", F.explode("bands").alias("band"))
    pivots = band.groupBy("band").agg(F.min("rep").alias("pivot"), F.max("rep").alias("most"), F.count("*").alias("n")).where("pivot != most")
    stars = written(band.join(pivots.drop("most"), "band").groupBy("pivot", "rep").agg(F.max("n").alias("n")), "stars")
    seen = written(verified(stars, docs, text), "verified")
    found = written(components(seen.where("linked").select(F.col("rep").alias("src"), F.col("pivot").alias("dst"))), "components")
    open_ = seen.where("NOT linked").select("pivot").distinct()
    if open_.isEmpty():
        return found
    # Groups with members that their pivot isn't similar to, and how many blocks each takes.
    heads = stars.where("pivot = rep").select("pivot", F.ceil(F.col("n") / BLOCK).alias("n_blocks")).join(open_, "pivot", "left_semi")
    members = stars.select("pivot", F.col("rep").alias("doc_id")).join(heads, "pivot").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    members = members.select("pivot", "doc_id", F.coalesce("component", "doc_id").alias("comp"), "n_blocks")
    some = written(partnered(members, reps), "partnered")
    more = forests(some, reps, docs, text)
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    joint = more.join(of("src"), "src", "left").join(of("dst"), "dst", "left").select(F.coalesce("src_of", "src").alias("src"), F.coalesce("dst_of", "dst").alias("dst"))
    joint = written(components(joint), "joint")
    # A component's new name; those that were single classes until now are added.
    both = found.join(joint.toDF("component", "joint"), "component", "left").select("node", F.coalesce("joint", "component").alias("component"))
    return both.unionByName(joint.join(found, "node", "left_anti").select("node", "component"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (src, dst): the smallest node reachable.

    Alternating stars: every node's larger neighbours, then its smaller ones, are
    linked to the smallest; stars of all components are left in a logarithmic
    number of steps.  Each step is written, so none is recomputed.
    """
    e = written(edges.where("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    state = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
    before = None
    while (now := state(e)) != before:
        before = now
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("src", "m"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src != dst").distinct()
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(least, "src").select(F.col("dst").alias("a"), "src", "m")
        small = small.select(F.col("a").alias("src"), F.col("m").alias("dst")).unionByName(small.select("src", F.col("m").alias("dst"))).where("src != dst").distinct()
        e = written(small, "edges")
    both = e.unionByName(e.select(F.col("dst").alias("src"), "dst"))
    return both.groupBy("src").agg(F.min("dst").alias("component")).withColumnRenamed("src", "node")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Without text or words: an empty set, linked with nothing.  Texts of any length
    are compared whole.  Other columns play no part, whatever their names.  Rows of
    one doc_id count as one document.  A null doc_id takes no part: it is kept, in no
    component (null).  An empty table gives an empty result.
    """
    sig = written(signatures(docs, text), "signatures")
    known = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    reps = known.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "bands", "n_shingles", "sketch")
    found = linked(reps, docs.where("doc_id IS NOT NULL"), text)
    of = classes.join(found, classes["rep"] == found["node"], "left").where("n > 1 OR component IS NOT NULL")
    of = of.select("set_key", F.coalesce("component", "rep").alias("component"))
    out = sig.select("doc_id", "n_shingles", "set_key").join(of, "set_key", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
