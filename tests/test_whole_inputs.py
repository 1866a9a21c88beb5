"""Queries take all of their input; small fixtures and brute force."""

import random

import pytest

from sparkloom.operators import graph as G
from sparkloom.plans import catalogue


def within(after, start, most):
    depth, layer = {}, set(start)
    for d in range(1, most + 1):
        layer = {b for a in layer for b in after.get(a, ())} - set(depth)
        depth.update(dict.fromkeys(layer, d))
    return depth


def table_of(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "src long, dst long")


def on_cycles(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    return sorted(a for a in after if a in within(after, [a], len(pairs) + 1))


@pytest.mark.parametrize("seed", range(2))
def test_cycles_of_random_graphs(spark, seed):
    """Sparse random graphs with loops, chains that lead into and out of rings, and a ring with a shortcut."""
    random.seed(seed)
    pairs = {(random.randrange(40), random.randrange(40)) for _ in range(34 + 8 * seed)}
    pairs |= {(100 + k, 101 + k) for k in range(9)} | {(109, 104)} | {(200 + k, 200 + (k + 1) % 7) for k in range(7)} | {(203, 300), (300, 301), (400, 203)}
    pairs |= {(500 + k, 500 + (k + 1) % 6) for k in range(6)} | {(500, 503)}
    assert sorted(r["node"] for r in G.cycle_nodes(table_of(spark, pairs)).collect()) == on_cycles(pairs)


def test_long_chains_and_rings(spark):
    """A chain of 1,000 edges has no cycle and a ring of 300 is one; both take a logarithmic number of rounds."""
    import time

    begin = time.perf_counter()
    assert G.cycle_nodes(table_of(spark, {(k, k + 1) for k in range(1000)})).collect() == []
    assert time.perf_counter() - begin < 90
    ring = {(k, (k + 1) % 300) for k in range(300)} | {(1000 + k, 1001 + k) for k in range(40)} | {(1040, 1000)}
    assert len(G.cycle_nodes(table_of(spark, ring)).collect()) == 341


def test_reach_takes_the_least_depth(spark):
    random.seed(3)
    pairs = {(random.randrange(60), random.randrange(60)) for _ in range(90)}
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    for most in (1, 3, 4, 7, 50):
        got = {r["node"]: r["depth"] for r in G.reach(table_of(spark, pairs), spark.createDataFrame([(0,), (1,)], "node long"), most).collect()}
        assert got == {**within(after, [0, 1], most), 0: 0, 1: 0}


def test_search_takes_every_query(spark, tmp_path):
    """Ids divisible by 20, ties and a zero vector among them, over several blocks."""
    from pyspark.sql import functions as F

    from sparkloom.operators import retrieval as R

    random.seed(3)
    rows = [(k, [float(random.randrange(-2, 3)) for _ in range(3)] if k != 40 else [0.0, 0.0, 0.0]) for k in range(205)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    v = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    queries = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))

    want = sorted(tuple(r) for r in R.cosine_search(v, queries, 10).select("query_id", "vec_id", "score", "rank").collect())
    for per, most in ((256, 4096), (2, 30)):
        got = R.cosine_blocks(v, queries, 10, 11, 205, per, most).select("query_id", "vec_id", "score", "rank")
        assert sorted(tuple(r) for r in got.collect()) == want
    got = catalogue.QUERIES["cosine_topk"](spark, str(tmp_path)).select("query_id").distinct().count()
    assert got == 11


def test_layers_see_the_whole_page(spark, tmp_path):
    pages = [(6, "http://h/x", "a" * 3000 + " OrderController"), (15, "http://h/x", "nothing")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["layer"] for r in catalogue.QUERIES["layer_rules"](spark, str(tmp_path)).collect()}
    assert got[6] != "Unknown" and got[15] == "Unknown"


def test_rename_rewrites_every_text(spark, sf_dir):
    import re

    import pandas as pd

    c = pd.read_parquet(f"{sf_dir}/conversations.parquet")
    word = r"(?<![^\W])the(?!\w)"
    want = sorted((r.conv_id, r.turn, r.text, re.sub(word, "THE", r.text)) for r in c.itertuples() if re.search(word, r.text))
    assert want and sorted(tuple(r) for r in catalogue.QUERIES["rename_preview"](spark, sf_dir).collect()) == want


def test_known_dimensions(spark):
    from sparkloom.sources import sinks, tables

    known = {"BAAI/bge-large-en": 1024, "bge-small": 512, "intfloat/e5-large-v2": 1024, "e5-small": 384, "nomic-embed-text:latest": 768, "mxbai-embed-large": 1024, "all-minilm:l6": 384, "text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": None}
    assert {m: tables.known_dimensions(m) for m in known} == known
    v = spark.createDataFrame([([0.0] * 384,)], "embedding array<float>")
    assert sinks.checked_vectors(v, model="e5-small").count() == len(sinks.checked_vectors(v, model="e5-small").collect()) == 1
    with pytest.raises(Exception, match="expected 512"):
        sinks.checked_vectors(v, model="bge-small").collect()


def test_graph_of_rule_symbols(spark):
    """Edges end in nodes; a name that several files have means the least id."""
    rows = [("a.rs", "main", "Function", 1, "fn main() { load(x); load(y) }"), ("b.rs", "load", "Function", 1, "fn load(p) { store(p) }"), ("c.rs", "store", "Function", 2, "fn store(p)"), ("d.rs", "store", "Function", 3, "fn store(q)")]
    nodes, edges = G.of_symbols(spark.createDataFrame(rows, "file string, name string, kind string, line int, context_snippet string"), "p")
    assert sorted(tuple(r) for r in edges.collect()) == [("p:a.rs:main", "p:b.rs:load"), ("p:b.rs:load", "p:c.rs:store"), ("p:d.rs:store", "p:c.rs:store")]
    assert nodes.count() == 4


def test_line_bases(spark):
    from sparkloom.operators import chunking as C

    c = C.by_lines(spark.createDataFrame([("f", "a\nb\nc")], "file string, content string"), "content", 20)
    got = lambda d: [(r["start_line"], r["end_line"]) for r in d.orderBy("chunk_no").collect()]
    assert got(c) == [(1, 2), (3, 3)] and got(C.compat_lines(c)) == [(0, 2), (2, 3)] and got(C.compat_lines(c, "fallback")) == [(1, 3), (3, 4)]
