"""The caller's view of a source tree, and the project catalogue."""

import pytest

from sparkloom.operators import graph, projects
from sparkloom.plans import source
from sparkloom.plans.engine import Engine


@pytest.fixture(scope="module")
def engine(spark):
    return Engine.over(source.files(spark))


def test_search(engine):
    assert {r["file"] for r in engine.search("findAll", 3).collect()} == {"service/UserService.java", "api/UserController.java"}
    assert engine.search("findAll", 3, "rust").isEmpty()


def vectors(engine):
    """Two dimensions: what is Java, and what is not."""
    from pyspark.sql import functions as F

    return engine.chunks.select("chunk_id", F.when(F.col("language") == "java", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("embedding"))


def test_hybrid_query(engine):
    java = {"service/UserService.java", "api/UserController.java"}
    e = Engine(engine.files, engine.records, vectors(engine))
    assert {r["chunk_id"] for r in e.semantic([1.0, 0.0], 2).collect()} == {r["chunk_id"] for r in e.chunks.where("language = 'java'").collect()}
    both = e.query("findAll", [1.0, 0.0], 2).collect()
    assert {r["file"] for r in both} == java and {r["source"] for r in both} == {"dense"}
    # Both lists hold both files: first and second in one order or the other; a class counts at its importance, the one call of the controller's file a hundredth.
    assert all(0.5 < r["final_score"] <= 1 for r in both) and both[0]["final_score"] >= both[1]["final_score"]
    assert {r["source"] for r in engine.query("findAll", k=2).collect()} == {"sparse"}
    assert {r["source"] for r in e.query("?", [1.0, 0.0], 2).collect()} == {"dense"}
    assert engine.query("?").isEmpty() and engine.search("").isEmpty()
    assert {r["file"] for r in e.query("findAll", [0.0, 1.0], 3, "java").collect()} == java
    with pytest.raises(ValueError):
        engine.semantic([1.0])


def test_files_and_flows(engine):
    assert [r["content"][:6] for r in engine.get_file("lib/a.rb").collect()] == ["class "] and engine.get_file("none").isEmpty()
    assert engine.get_summary("lib/a.rb").first()["summary"] == "Code chunk (6 tokens):\nclass Box\n  def open\n  end\nend"
    assert {r["symbol_id"] for r in engine.search_flow("GETUSERS").collect()} >= {"api/UserController.java::getUsers::Method"}
    assert engine.search_flow("no such flow").isEmpty()


def test_lookups(engine):
    assert [r["file"] for r in engine.find_definition("findAll").collect()] == ["service/UserService.java"]
    caller, callee = "api/UserController.java::getUsers::Method", "service/UserService.java::findAll::Method"
    assert [r[0] for r in engine.callers(callee).collect()] == [caller]
    assert [r[0] for r in engine.callees(caller).collect()] == [callee]
    assert [r["node"] for r in engine.flow_between(caller, "service/UserService.java::query::Method").collect()] == [caller, callee, "service/UserService.java::query::Method"]
    assert engine.flow_between(callee, caller).isEmpty() and engine.cycles().isEmpty()
    assert {(r["line"], r["after"].strip()) for r in engine.rename_preview("fetch", "get").collect()} == {(8, "return get()"), (10, "def get():")}
    assert [r["node"] for r in engine.related(caller).collect()] == [callee, "service/UserService.java::query::Method"]
    assert engine.context_at("lib/a.c", 2).count() == 1 and engine.symbol_map().count() == 8


def test_projects(spark):
    p = spark.createDataFrame([("b", "/b", 2, None), ("a", "/a", 1, None)], "name string, root string, created_at int, is_default boolean")
    d = projects.with_default(p)
    assert [r["name"] for r in d.where("is_default").collect()] == ["a"]
    assert [r["name"] for r in projects.removed(d, "a").where("is_default").collect()] == ["b"]
    with pytest.raises(Exception, match="project exists"):
        projects.added(d, p.where("name = 'a'")).collect()
    assert graph.inserted(spark.createDataFrame([("x", 1)], "node string, n int"), spark.createDataFrame([("x", 2)], "node string, n int")).collect()[0]["n"] == 2
