"""Sources, sinks and streams on small folders."""

import hashlib
import hmac
import json

from pyspark.sql import functions as F

from sparkloom.sources import sinks, tables
from sparkloom.streaming import feed


def tree(tmp_path):
    for name, body in {"src/a.rs": b"fn a() {}", "src/b.TS": b"x", "target/c.rs": b"c", "node_modules/d.js": b"d", "logs/e.py": b"e", "bin.rs": b"a\0b", "x.png": b"png", ".gitignore": b"logs\n# note\n"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    return str(tmp_path)


def names(df, column="file"):
    return sorted(r[column] for r in df.select(column).collect())


def test_scans(spark, tmp_path):
    root = tree(tmp_path)
    assert names(tables.project_files(spark, root)) == ["bin.rs", "src/a.rs", "src/b.TS"]
    assert names(tables.analyzer_files(spark, root)) == ["bin.rs", "logs/e.py", "src/a.rs", "src/b.TS"]
    assert names(tables.language_files(spark, root, "rust")) == ["bin.rs", "src/a.rs", "target/c.rs"]
    assert names(tables.matching_files(spark, root, "*.rs")) == ["bin.rs", "src/a.rs", "target/c.rs"]
    found = {r["path"]: r["hash"] for r in tables.text_files(spark, root).collect()}
    assert found["src/a.rs"] == hashlib.sha256(b"fn a() {}").hexdigest() and "bin.rs" not in found and "x.png" not in found


def test_json_sources(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"timestamp": 1, "provider": "p", "model": "m", "tokens": 2, "cost_usd": 0.5}\nbroken\n')
    assert [tuple(r) for r in tables.cost_audit(spark, str(tmp_path / "c.jsonl")).collect()] == [(1, "p", "m", 2, 0.5)]
    raw = spark.createDataFrame([('{"name": "a", "path": "f", "line": 3, "kind": "function"}',), ("no",), ('{"name": "b", "kind": "odd"}',)], "value string")
    assert [tuple(r) for r in tables.tags(raw).collect()] == [("a", "f", 3, "Function", "Public")]
    body = json.dumps({"commits": [{"added": ["x"], "modified": ["y", "x"]}]})
    p = spark.createDataFrame([(1, body, None), (2, body, "h1, h2")], "id int, body string, changed_files string")
    assert sorted((r["id"], r["path"]) for r in tables.webhook_changes(p).collect()) == [(1, "x"), (1, "y"), (2, "h1"), (2, "h2")]
    good = "sha256=" + hmac.new(b"key", body.encode(), "sha256").hexdigest()
    assert p.select(tables.signed(F.col("body"), F.lit(good), "key")).first()[0] is True


def test_submodules(spark):
    raw = spark.createDataFrame([("f", k, v) for k, v in enumerate(['[submodule "lib"]', "  path = vendor/lib", "  url = u", '[submodule "b"]', "  path = b"])], "file string, n int, value string")
    assert sorted((r["name"], r["path"]) for r in tables.submodules(raw).collect()) == [("b", "b"), ("lib", "vendor/lib")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", "a", 1), ("q", "b", 2)], "project_id string, path string, n int")
    sinks.save_snapshot({"t": df}, str(tmp_path / "s"))
    assert names(sinks.load_table(spark, str(tmp_path / "s"), "t", df.schema), "path") == ["a", "b"]
    assert sinks.load_table(spark, str(tmp_path / "s"), "missing", df.schema).isEmpty()
    sinks.replace_projects(spark.createDataFrame([("p", "c", 3)], df.schema), str(tmp_path / "s" / "t"))
    assert names(spark.read.parquet(str(tmp_path / "s" / "t")), "path") == ["b", "c"]
    sinks.backup({"t": df}, str(tmp_path / "b"))
    assert sorted(map(tuple, sinks.restore(spark, str(tmp_path / "b"), {"t": df.schema})["t"].collect())) == sorted(map(tuple, df.collect()))
    assert names(sinks.upserted(df, spark.createDataFrame([("p", "a", 9)], df.schema), "path"), "n") == [2, 9]


def test_feed(spark, tmp_path):
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()
    index = lambda b: b.select("path", F.col("length").cast("long").alias("n"))
    (src / "a").write_text("aa")
    feed.indexed(feed.files(spark, str(src)), out, mark, index).awaitTermination()
    (src / "b").write_text("b")
    feed.indexed(feed.files(spark, str(src)), out, mark, index).awaitTermination()
    assert names(spark.read.parquet(out + "/v1"), "n") == [1, 2]


def test_task_states(spark):
    e = spark.createDataFrame([(1, 1, "start"), (1, 2, "finish"), (2, 1, "finish"), (2, 2, "cancel"), (3, 1, "start")], "task_id long, ts long, event string")
    assert {r["task_id"]: r["state"] for r in feed.task_states(e).collect()} == {1: "finished", 2: "canceled", 3: "running"}
