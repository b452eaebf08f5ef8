"""Graphs of dependencies and calls as edge tables (src, dst)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> str:
    """The session's checkpoint folder, which the driver and all executors share; a local session without one gets its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (sc.master.startswith("local") and "cluster" not in sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="millrace-graph-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables below the checkpoint folder."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def _checkpoint(df: DataFrame) -> DataFrame:
    _shared(df.sparkSession)
    return df.checkpoint()


def _long(df: DataFrame) -> DataFrame:
    """A table that grows with the graph: joins shuffle it, so no round collects it on the driver for a broadcast."""
    return df.hint("merge")


def aggregate_edges(dependencies: DataFrame, *keys: str) -> DataFrame:
    """Per (src, dst) and keys: sum of weights, sorted set of types, count. dependencies: src, dst, weight, type."""
    return dependencies.groupBy(*keys, "src", "dst").agg(
        F.sum("weight").alias("weight"), F.array_sort(F.collect_set("type")).alias("types"), F.count("*").alias("n")
    )


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    ends = ends.union(e.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def graph_metrics(edges: DataFrame) -> DataFrame:
    d = degrees(edges).agg(
        F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"), F.max("in_degree").alias("max_in"), F.max("out_degree").alias("max_out")
    )
    n, m = F.col("nodes"), F.col("edges")
    return d.withColumn("density", F.when(n > 1, m / (n * (n - 1))).otherwise(0.0)).withColumn("avg_degree", m / n)


def sources(edges: DataFrame) -> DataFrame:
    """Nodes without an incoming edge (entry points)."""
    return edges.select(F.col("src").alias("node")).distinct().join(_long(edges.select(F.col("dst").alias("node")).distinct()), "node", "left_anti")


def sinks(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("node")).distinct().join(_long(edges.select(F.col("src").alias("node")).distinct()), "node", "left_anti")


def weak_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node and component (its least node), by min-label hops with pointer jumping."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    both = _checkpoint(both.where("src <> dst"))
    labels = _checkpoint(nodes(edges).withColumn("component", F.col("node")))
    for _ in range(max_rounds):
        near = both.join(_long(labels), both.dst == labels.node).groupBy("src").agg(F.min("component").alias("m"))
        step = labels.join(_long(near), labels.node == near.src, "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"))
        up = step.select(F.col("node").alias("n"), F.col("component").alias("c"))
        step = _checkpoint(step.join(_long(up), step.component == up.n).select("node", F.col("c").alias("component")))
        changed = step.join(_long(labels.withColumnRenamed("component", "old")), "node").where("component <> old").isEmpty()
        labels = step
        if changed:
            return labels
    raise RuntimeError("components did not settle")


def cyclic_part(edges: DataFrame, *keys: str) -> DataFrame:
    """The edges that lie on cycles or between them, of the graphs that keys tell apart.

    Peels edges from nodes that nothing points at and edges to nodes that point at nothing, until
    none go; each round is written out and counted.
    """
    left = _checkpoint(edges.select(*keys, "src", "dst").distinct())
    n = left.count()
    while n:
        pointed = left.select(*keys, F.col("dst").alias("src")).distinct()
        pointing = left.select(*keys, F.col("src").alias("dst")).distinct()
        left = _checkpoint(left.join(_long(pointed), [*keys, "src"], "left_semi").join(_long(pointing), [*keys, "dst"], "left_semi").select(*keys, "src", "dst"))
        before, n = n, left.count()
        if n == before:
            break
    return left


def is_dag(edges: DataFrame) -> bool:
    return cyclic_part(edges).isEmpty()


def call_edges(facts: DataFrame) -> DataFrame:
    """Per file, caller and callee: how many calls there are, and their lines. facts: see pyast.file_facts."""
    calls = facts.where("kind = 'call'").groupBy("repo_id", "path", F.col("caller").alias("src"), F.col("name").alias("dst"))
    return calls.agg(F.count("*").alias("n"), F.array_sort(F.collect_list("line")).alias("lines"))


def call_graphs(calls: DataFrame) -> DataFrame:
    """Nodes, edges, density and whether it has no cycle, of each file's call graph. calls: see call_edges."""
    calls = _checkpoint(calls.select("repo_id", "path", "src", "dst"))  # read four times, made once
    ends = calls.select("repo_id", "path", F.explode(F.array("src", "dst")).alias("node")).distinct()
    sizes = ends.groupBy("repo_id", "path").agg(F.count("*").alias("nodes"))
    edges = calls.groupBy("repo_id", "path").agg(F.count("*").alias("edges"))
    loops = cyclic_part(calls, "repo_id", "path").select("repo_id", "path", F.lit(False).alias("is_dag")).distinct()
    n, m = F.col("nodes"), F.col("edges")
    rows = sizes.join(_long(edges), ["repo_id", "path"]).join(_long(loops), ["repo_id", "path"], "left")
    return rows.select("repo_id", "path", "nodes", "edges", F.when(n > 1, m / (n * (n - 1))).otherwise(0.0).alias("density"), F.coalesce("is_dag", F.lit(True)).alias("is_dag"))


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (node, colour) after the least colour has gone along edges (src to dst) as far as it does.

    Edges must join nodes that may share a colour only; each round is written out and compared.
    """
    while True:
        came = edges.join(_long(labels), edges.src == labels.node).groupBy("dst").agg(F.min("colour").alias("new"))
        step = labels.join(_long(came), labels.node == came.dst, "left").select("node", F.least("colour", F.coalesce("new", "colour")).alias("colour"))
        step = _checkpoint(step)
        if step.join(_long(labels.withColumnRenamed("colour", "old")), "node").where("colour <> old").isEmpty():
            return step
        labels = step


def strong_components(edges: DataFrame) -> DataFrame:
    """node and component (its least node), by colouring forwards and backwards over edge tables.

    Only the part that lies on or between cycles is coloured; every other node is a component of
    its own. A colour is the least node that reaches a node; the nodes of a colour that reach that
    node back are its component, and the rest goes on without them.
    """
    names = nodes(edges)
    left = cyclic_part(edges.where("src <> dst"))
    found = None
    while not left.isEmpty():
        colours = _spread(left, _checkpoint(nodes(left).withColumn("colour", F.col("node"))))
        c, d = colours.alias("c"), colours.alias("d")
        inside = left.join(_long(c), left.src == F.col("c.node")).join(_long(d), left.dst == F.col("d.node")).where("c.colour = d.colour")
        inside = _checkpoint(inside.select(F.col("c.colour").alias("colour"), "src", "dst"))
        # backwards from each colour's own node
        reached = _checkpoint(colours.where("node = colour"))
        n = reached.count()
        while True:
            more = inside.join(_long(reached), (inside.dst == reached.node) & (inside.colour == reached.colour)).select(inside.src.alias("node"), inside.colour)
            reached = _checkpoint(reached.union(more).distinct())
            before, n = n, reached.count()
            if n == before:
                break
        found = reached if found is None else found.union(reached)
        gone = reached.select("node")
        left = left.join(_long(gone.withColumnRenamed("node", "src")), "src", "left_anti").join(_long(gone.withColumnRenamed("node", "dst")), "dst", "left_anti")
        left = cyclic_part(left)
    if found is None:
        return names.select("node", F.col("node").alias("component"))
    return names.join(_long(found), "node", "left").select("node", F.coalesce("colour", "node").alias("component"))


def betweenness(edges: DataFrame) -> DataFrame:
    """node and its betweenness (unweighted, normalised by (n - 1)(n - 2)), by joins over frontiers.

    Every node's search goes at the same time: a level holds (source, node, shortest paths), and a
    round extends all of them by one edge; going back, each level hands its dependencies on. The
    rows are those of all shortest-path searches, spread over (source, node).
    """
    e = _checkpoint(edges.where("src <> dst").select("src", "dst").distinct())
    names = nodes(edges)
    n = names.count()
    level = _checkpoint(names.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("paths")))
    seen, levels = level.select("s", "node"), [level]
    while True:
        out = level.join(e, level.node == e.src).groupBy("s", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        level = _checkpoint(out.join(seen, ["s", "node"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = _checkpoint(seen.union(level.select("s", "node")))
    share = levels[-1].select("s", "node", "paths", F.lit(0.0).alias("share"))
    every = share
    for near in reversed(levels[1:-1]):
        step = near.alias("v").join(e, F.col("v.node") == F.col("src")).select("v.s", F.col("v.node").alias("v"), F.col("v.paths").alias("pv"), "dst")
        w = share.select("s", F.col("node").alias("dst"), F.col("paths").alias("pw"), "share")
        given = step.join(w, ["s", "dst"]).groupBy("s", "v").agg(F.sum(F.col("pv") / F.col("pw") * (1 + F.col("share"))).alias("share"))
        share = near.join(given.withColumnRenamed("v", "node"), ["s", "node"], "left").select("s", "node", "paths", F.coalesce("share", F.lit(0.0)).alias("share"))
        share = _checkpoint(share)
        every = every.union(share)
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    sums = every.where("s <> node").groupBy("node").agg(F.sum("share").alias("sum"))
    return names.join(sums, "node", "left").select("node", (F.coalesce("sum", F.lit(0.0)) * scale).alias("betweenness"))


def most_central(edges: DataFrame, k: int = 5) -> DataFrame:
    return betweenness(edges).orderBy(F.desc("betweenness"), "node").limit(k)


def cycles(edges: DataFrame) -> DataFrame:
    """All elementary cycles, each once, from its least node: cycle ARRAY.

    Only paths within the part of the graph that has cycles grow; each round's are written out.
    Their number is the graph's own: a dense graph has more cycles than any table holds.
    """
    e = cyclic_part(edges)
    paths = e.where("src <= dst").select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src").alias("path"))
    found = None
    while True:
        closed = paths.where("at = start").select(F.col("path").alias("cycle"))
        found = closed if found is None else found.union(closed)
        grown = paths.where("at > start").join(_long(e), F.col("at") == F.col("src")).where((F.col("dst") >= F.col("start")))
        grown = grown.where((F.col("dst") == F.col("start")) | ~F.array_contains(F.col("path"), F.col("dst")) & (F.col("dst") != F.col("at")))
        paths = _checkpoint(grown.select("start", F.col("dst").alias("at"), F.concat("path", F.array("src")).alias("path")))
        if paths.isEmpty():
            return found


def simple_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_edges: int = 6) -> DataFrame:
    """Simple paths from starts to ends (one column node each) of at most max_edges edges.

    Nodes are labelled first with their least distance to any end, going backwards; a path then only
    grows to nodes from which an end can still be reached, so what can't arrive is never extended.
    """
    e = _checkpoint(edges.select("src", "dst").distinct())
    level = _checkpoint(ends.select("node", F.lit(0).alias("far")).distinct())
    every = level
    for d in range(1, max_edges + 1):
        back = level.join(_long(e), F.col("node") == F.col("dst")).select(F.col("src").alias("node")).distinct()
        level = _checkpoint(back.join(_long(every), "node", "left_anti").withColumn("far", F.lit(d)))
        if level.isEmpty():
            break
        every = every.union(level)
    every = _checkpoint(every)
    # an edge with the distance from its end: what a path can take next
    ahead = _checkpoint(e.join(_long(every), F.col("dst") == F.col("node")).select("src", "dst", "far"))
    paths = starts.join(_long(every), "node", "left_semi").select(F.col("node").alias("at"), F.array("node").alias("path"))
    found = None
    for d in range(1, max_edges + 1):
        paths = paths.join(_long(ahead.where(F.col("far") <= max_edges - d)), F.col("at") == F.col("src")).where(~F.array_contains(F.col("path"), F.col("dst")))
        paths = _checkpoint(paths.select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), (F.col("far") == 0).alias("end")))
        done = paths.where("end").select("path")
        found = done if found is None else found.union(done)
    return found


def refactoring(edges: DataFrame, max_cycles: int = 5) -> DataFrame:
    """Suggestions: nodes of three times the mean degree, and the first cycles."""
    d = _checkpoint(degrees(edges)).withColumn("all", F.lit(1))
    mean = d.agg(F.avg("in_degree").alias("mi"), F.avg("out_degree").alias("mo")).withColumn("all", F.lit(1))
    d = d.join(F.broadcast(mean), "all")
    rows = d.where("in_degree > 3 * mi").select(F.lit("high_coupling").alias("type"), F.col("node").cast("string").alias("node"), F.lit("high").alias("priority"), F.col("in_degree").alias("n"))
    rows = rows.union(d.where("out_degree > 3 * mo").select(F.lit("high_fanout"), F.col("node").cast("string"), F.lit("medium"), "out_degree"))
    loops = cycles(edges).orderBy("cycle").limit(max_cycles)
    return rows.union(loops.select(F.lit("circular_dependency"), F.array_join(F.col("cycle").cast("array<string>"), ">"), F.lit("high"), F.size("cycle").cast("long")))


def dot_line() -> Column:
    """The DOT line of an edge (src, dst, weight), with the weight where it is above one."""
    label = F.when(F.col("weight") > 1, F.format_string(' [label="x%d"]', F.col("weight").cast("int"))).otherwise("")
    return F.concat(F.lit('  "'), "src", F.lit('" -> "'), "dst", F.lit('"'), label, F.lit(";"))


def dot(edges: DataFrame) -> DataFrame:
    """One DOT line per edge, in order."""
    return edges.orderBy("src", "dst").select(dot_line().alias("line"))


def dependency_edges(facts: DataFrame) -> DataFrame:
    """Import, call and inheritance edges from the rows of pyast.file_facts: repo_id, src, dst, weight, type."""
    from ..functions import paths

    file = paths.stem(F.col("path"))
    imports = facts.where("kind = 'import'").select("repo_id", file.alias("src"), F.col("qualified").alias("dst"), F.lit(1.0).alias("weight"), F.lit("import").alias("type"))
    calls = facts.where("kind = 'call'").select("repo_id", F.concat(file, F.lit("."), "caller").alias("src"), F.col("name").alias("dst"), F.lit(1.0).alias("weight"), F.lit("call").alias("type"))
    bases = facts.where("kind = 'class'").select("repo_id", F.concat(file, F.lit("."), "name").alias("src"), F.explode("bases").alias("dst"), F.lit(1.0).alias("weight"), F.lit("inheritance").alias("type"))
    return imports.union(calls).union(bases)


def resolved_calls(facts: DataFrame) -> DataFrame:
    """Calls with the definition in the same file that they name, if there is one: an extension."""
    calls = facts.where("kind = 'call'").select("repo_id", "path", "caller", "name", "line")
    defined = facts.where("kind = 'function'").select("repo_id", "path", "name", F.lit(True).alias("local")).distinct()
    joined = calls.join(defined, ["repo_id", "path", "name"], "left")
    callee = F.when(F.col("local"), F.concat("path", F.lit(":"), "name")).otherwise(F.col("name"))
    return joined.select("repo_id", F.concat("path", F.lit(":"), "caller").alias("src"), callee.alias("dst"), "line")
