"""Pipeline stages on odd rows: nulls, empty and repeated texts, extra columns with clashing names, and no rows."""

import time

import pyarrow as pa
import pytest

from sparkloom.llm.common import written

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, part int"


@pytest.fixture(scope="module")
def odd(spark):
    words = " ".join(f"the word{k} of" for k in range(40))
    texts = [(1, words), (2, words), (3, None), (4, ""), (None, words + " tail of it"), (5, words.replace("word7 ", "other ")), (6, " ".join(f"un mot{k} de chose{k}" for k in range(60)))]
    return spark.createDataFrame([(i, t, None, None, None, 0.9, False, 1) for i, t in texts], SCHEMA)


def test_stages(spark, sf_dir, odd):
    docs, seen = odd, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), "edge")
        seen[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert sorted(map(str, seen["quality rules"])) == ["1", "2", "5", "6", "None"]
    assert sorted(map(str, seen["near-duplicates"])) == ["1", "6", "None"]
    assert set(seen["packing"]) == set(seen["near-duplicates"])


def test_no_rows(spark, sf_dir, odd):
    docs = odd.where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), "none")
        assert docs.count() == 0


def test_packing_leaves_no_memory_behind(spark):
    """Workers live on through the stages after: what a task has learnt and what it worked with are given back at its end."""
    import public_tokenizers

    from sparkloom.llm import packing, stretches

    path = public_tokenizers.path("word_bpe_49k.json")

    def held(batches):
        own = packing.tokens(path).stretches
        with open("/proc/self/smaps_rollup") as f:
            kb = sum(int(line.split()[1]) for line in f if line.startswith("Pss_Anon"))
        for _ in batches:
            time.sleep(1)  # so that each partition finds a worker of its own
            yield pa.RecordBatch.from_pydict({"n": [len(own.known) + len(own.elder)], "mb": [kb // 1024]})

    env = spark.sparkContext.environment
    env["FRESH_WORKERS"] = "1"  # not those of other tests
    try:
        docs = spark.range(0, 8000, 1, 4).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 200), x -> substring(md5(concat(id, ' ', x)), 1, 8)), ' ') AS text")
        assert packing.pieces(docs, path).agg({"length": "sum"}).first()[0] > 1_600_000
        left = spark.range(0, 4, 1, 4).mapInArrow(held, "n long, mb long").toPandas()
    finally:
        del env["FRESH_WORKERS"]
    assert left.n.max() <= stretches.KEPT and left.mb.max() < 150
