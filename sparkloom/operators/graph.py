"""Graphs as node and edge tables: neighbours, degrees, traversal, cycles, flows.

Iterative operators take several steps in one plan, write what is new to the
shared folder, and stop when a round adds nothing.  Runs of nodes with a single
predecessor (or successor) are followed by pointer jumping, so a chain or a ring
of n edges takes log n rounds, not n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sparkloom.sources.shared import written

#: Steps of a traversal in one plan.
HOPS = 3


def _cut(df: DataFrame) -> DataFrame:
    return written(df, "graph")


def _counted(df: DataFrame, condition: Column | None = None) -> tuple[DataFrame, int]:
    """df written, and how many of its rows meet the condition, counted by the tasks that write them: no job of its own."""
    seen = Observation()
    n = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    out = _cut(df.observe(seen, n.alias("n")))
    return out, seen.get.get("n", 0)


def callers(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("dst") == node).select(F.col("src").alias("caller"))


def callees(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("src") == node).select(F.col("dst").alias("callee"))


def neighbours(edges: DataFrame, node, kinds: list[str] | None = None) -> DataFrame:
    e = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    return e.where(F.col("src") == node).select(F.col("dst").alias("node")).distinct()


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n, e = nodes.agg(F.count("*").alias("n_nodes")), edges.agg(F.count("*").alias("n_edges"))
    return n.join(F.broadcast(e), F.lit(True)).withColumn("avg_degree", F.round(F.when(F.col("n_nodes") > 0, F.col("n_edges") / F.col("n_nodes")).otherwise(0.0), 6))


def bottlenecks(edges: DataFrame, k: int) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(k)


def resolved(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds callee_id: the symbol whose id the target text is, else the least id among those of that name, else null."""
    by_id = symbols.select(F.col("id").alias("dst"), F.col("id").alias("_by_id")).distinct()
    by_name = symbols.groupBy(F.col("name").alias("dst")).agg(F.min("id").alias("_by_name"))
    return edges.join(by_id, "dst", "left").join(by_name, "dst", "left").withColumn("callee_id", F.coalesce("_by_id", "_by_name")).drop("_by_id", "_by_name")


def reach(edges: DataFrame, start: DataFrame, max_depth: int = 3, include_start: bool = True, kinds: list[str] | None = None) -> DataFrame:
    """(node, depth) of the nodes within max_depth steps of start (node), each at its least depth."""
    e = (edges.where(F.col("kind").isin(*kinds)) if kinds else edges).select("src", "dst").distinct()
    if max_depth > HOPS:
        e = _cut(e)
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    frontier, depth = seen, 0
    while depth < max_depth:
        layer, new = frontier, None
        for depth in range(depth + 1, min(depth + HOPS, max_depth) + 1):  # noqa: B020
            layer = layer.join(e, layer["node"] == e["src"]).select(F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(depth))
            new = layer if new is None else new.unionByName(layer)
        new = new.groupBy("node").agg(F.min("depth").alias("depth")).join(seen.select("node"), "node", "left_anti")
        if depth < max_depth:
            new, left = _counted(new, F.col("depth") == depth)
            frontier = new.where(F.col("depth") == depth)
            if not left:
                depth = max_depth
        seen = seen.unionByName(new)
    return seen if include_start else seen.where("depth > 0")


def _ends(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of distinct edges without loops: nodes that nothing but a run of single predecessors from a source leads to (sources included), and nodes on rings whose only way in is the ring.

    Neither lie on other cycles.  Pointers of nodes with one predecessor jump to
    their predecessor's, so their reach doubles each round; open ones haven't
    met a node without, or with several.
    """
    into = e.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("at"), F.count("*").alias("n"))
    single = into.where("n = 1").select("node", "at")
    p, left = _counted(single.join(single.select(F.col("node").alias("at"), F.lit(True).alias("open")), "at", "left").select("node", "at", F.coalesce("open", F.lit(False)).alias("open")), F.col("open"))
    steps, before = 1, -1
    while left and (left != before or steps < left):
        q = p.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("open").alias("more"))
        before, steps = left, steps * 2
        p, left = _counted(p.where("open").join(q, "at").select("node", F.col("next").alias("at"), F.col("more").alias("open")).unionByName(p.where("NOT open")), F.col("open"))
    sources = e.select(F.col("src").alias("node")).distinct().join(into.select("node"), "node", "left_anti")
    lone = p.where("NOT open").join(sources.withColumnRenamed("node", "at"), "at", "left_semi").select("node")
    return sources.unionByName(lone), p.where("open").select(F.col("at").alias("node")).distinct()


def _reversed(e: DataFrame) -> DataFrame:
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _without(e: DataFrame, nodes: DataFrame) -> DataFrame:
    return e.join(nodes.select(F.col("node").alias("src")), "src", "left_anti").join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti")


def _trimmed(e: DataFrame, n: int, found: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """Without edges (n of them) that can't lie on a cycle because nothing leads to them or from them, how many are left, and found with rings that were met.

    Turns go forward and backward until two in a row take nothing.
    """
    idle, forward = 0, True
    while n and idle < 2:
        ends, rings = _ends(e if forward else _reversed(e))
        e, left = _counted(_without(e, ends.unionByName(rings)))
        found, idle, n, forward = found.unionByName(rings), idle + 1 if left == n else 0, left, not forward
    return e, n, found


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """The nodes on any cycle, self-loops included.

    Edges that can't lie on a cycle are trimmed.  What the node of most edges
    reaches and is reached by is its strongly connected component, usually the
    giant one; it leaves first.  Of what is left, colours spread forward:
    each node takes the largest id that reaches it; a colour's own node then
    spreads backward within its colour, and what it reaches is its component.
    Settled nodes leave, and the rest goes on.
    """
    e, n = _counted(edges.select("src", "dst").distinct(), F.col("src") != F.col("dst"))
    found = e.where("src = dst").select(F.col("src").alias("node"))
    e, n, found = _trimmed(e.where("src != dst"), n, found)
    if not n:
        return found.distinct()
    hub = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("a")).join(e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("b")), "node")
    hub = _cut(hub.orderBy((F.col("a") * F.col("b")).desc(), "node").limit(1).select("node"))
    own, several = _counted(reach(e, hub, 1 << 30).join(reach(_reversed(e), hub, 1 << 30).select("node"), "node", "left_semi").select("node"))
    if several > 1:
        found = found.unionByName(own)
        e, n = _counted(_without(e, own))
    while True:
        e, n, found = _trimmed(e, n, found)
        if not n:
            return found.distinct()
        colour = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("colour", F.col("node"))
        changed = True
        while changed:
            come = e.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("c"))
            new, changed = _counted(colour.join(come, "node", "left").select("node", F.greatest("colour", "c").alias("colour"), (F.col("c") > F.col("colour")).alias("up")), F.col("up"))
            colour = new.select("node", "colour")
        c1, c2 = colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("b"))
        inside = _cut(e.join(c1, "src").join(c2, "dst").where("a = b").select("src", "dst"))
        scc = reach(_reversed(inside), colour.where("node = colour").select("node"), 1 << 30).join(colour, "node")
        several = scc.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1")
        found = _cut(found.unionByName(scc.join(several, "colour", "left_semi").select("node")))
        e, n = _counted(_without(e, scc.select("node")))


def flagged(nodes: DataFrame, kinds: list[DataFrame]) -> DataFrame:
    """nodes with in_cycle: whether a node is on a cycle of any of several kinds of edges (calls, imports), each taken by itself."""
    found = None
    for e in kinds:
        c = cycle_nodes(e)
        found = c if found is None else found.unionByName(c)
    return nodes.join(found.distinct().withColumn("in_cycle", F.lit(True)), "node", "left").na.fill(False, ["in_cycle"])


def of_symbols(symbols: DataFrame, project: str = "") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of rule symbols (file, name, kind, line, context_snippet): a call names the least id among the symbols of that name, so edges meet nodes."""
    from sparkloom.functions import text

    node = lambda c: F.concat_ws(":", F.lit(project), F.col(f"{c}file"), F.col(f"{c}name"))
    s = symbols.withColumn("node", node(""))
    called = s.select(F.col("node").alias("src"), F.explode(text.calls(F.col("context_snippet"))).alias("name"))
    by_name = s.groupBy("name").agg(F.min("node").alias("dst"))
    edges = called.join(by_name, "name").where("src != dst").select("src", "dst").distinct()
    return s.select("node", "kind", "file", "name").distinct(), edges


def cycle_paths(edges: DataFrame, max_length: int = 8) -> DataFrame:
    """Simple cycles of up to max_length nodes, for display: each once, from its least node, with the closing node.  Meant for the few edges among cycle_nodes."""
    e = edges.select("src", "dst").distinct()
    paths = e.where("dst >= src").select(F.array("src", "dst").alias("path"))
    out = paths.where("path[0] = path[1]")
    paths = paths.where("path[0] != path[1]")
    for _ in range(max_length - 1):
        step = paths.join(e, F.element_at("path", -1) == F.col("src")).where("dst >= path[0]")
        out = out.unionByName(step.where("dst = path[0]").select(F.concat("path", F.array("dst")).alias("path")))
        paths = step.where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
    return out


def flows(symbols: DataFrame, calls: DataFrame, entries: dict[str, str], layer, max_depth: int = 10) -> DataFrame:
    """Execution flows from symbols (id, name, file, annotations) with an entry annotation: flow_id, flow_type, step, symbol_id, depth.

    Steps are the symbols reachable by resolved calls within max_depth, by least
    depth, then id.
    """
    kind = F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])
    start = symbols.withColumn("annotation", F.explode("annotations")).where(F.col("annotation").isin(*entries)).select("id", "name", F.element_at(kind, F.col("annotation")).alias("flow_type"))
    e = calls.select(F.col("src"), F.col("callee_id").alias("dst")).where("dst IS NOT NULL").distinct()
    seen = start.select(F.concat(F.lit("flow::"), "id").alias("flow_id"), F.concat("flow_type", F.lit("::"), "name").alias("name"), "flow_type", F.col("id").alias("symbol_id"), F.lit(0).alias("depth")).distinct()
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.join(e, F.col("symbol_id") == F.col("src")).select("flow_id", "name", "flow_type", F.col("dst").alias("symbol_id"), F.lit(depth).alias("depth")).distinct()
        frontier = _cut(step.join(seen.select("flow_id", "flow_type", "symbol_id"), ["flow_id", "flow_type", "symbol_id"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.join(symbols.select(F.col("id").alias("symbol_id"), "file", layer.alias("layer")), "symbol_id").orderBy("flow_id", "depth", "symbol_id")


def isolated(edges: DataFrame, project: str) -> DataFrame:
    return edges.where(F.col("project_id") == project)


def related(edges: DataFrame, node, k: int = 10) -> DataFrame:
    """Nodes within two steps, those of highest degree first."""
    start = edges.sparkSession.createDataFrame([(node,)], f"node {dict(edges.dtypes)['src']}")
    near = reach(edges, start, 2, include_start=False)
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return near.join(degree, "node", "left").na.fill(0, ["degree"]).orderBy(F.desc("degree"), "depth", "node").limit(k)


def path(edges: DataFrame, start, end, max_depth: int = 10) -> DataFrame:
    """A shortest path (node, depth) from start to end, the least ids first; none if end isn't within max_depth.

    Nodes' depths from start are joined with the edges once a step, backward from end.
    """
    spark, kind = edges.sparkSession, dict(edges.dtypes)["src"]
    depth = _cut(reach(edges, spark.createDataFrame([(start,)], f"node {kind}"), max_depth))
    last = depth.where(F.col("node") == end).first()
    found, node = [], end
    for d in range(last["depth"] if last else -1, -1, -1):
        found.append((node, d))
        if d:
            node = depth.where(F.col("depth") == d - 1).join(edges.where(F.col("dst") == node), F.col("node") == F.col("src")).agg(F.min("node")).first()[0]
    return spark.createDataFrame(found[::-1], f"node {kind}, depth int")


def inserted(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes with new ones in place of those of the same id; edges are appended by unionByName."""
    return nodes.join(new.select("node"), "node", "left_anti").unionByName(new)
