"""Execution paths and the assembly of each file's call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph
from .graph import _checkpoint, _long


def first_ends(edges: DataFrame, *keys: str, count: int = 3) -> tuple[DataFrame, DataFrame]:
    """Of each graph, the first nodes that nothing points at and the first that point at nothing (keys and node, in order)."""

    def ends(own: str, other: str) -> DataFrame:
        here = edges.select(*keys, F.col(own).alias("node")).distinct()
        rows = here.join(_long(edges.select(*keys, F.col(other).alias("node")).distinct()), [*keys, "node"], "left_anti")
        rank = F.row_number().over((W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("node"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= count).drop("rank")

    return ends("src", "dst"), ends("dst", "src")


def execution_paths(edges: DataFrame, *keys: str, count: int = 3, max_edges: int = 6) -> DataFrame:
    """keys, source, target, path, depth and calls of the simple paths from the first sources to the first sinks of each graph.

    edges: keys, src, dst and calls (an array); a path's calls are those of its hops in order. Nodes are
    labelled first with their least distance to each sink, going backwards; a path then only
    grows to nodes from which its sink can still be reached within max_edges, so what can't
    arrive is never extended.
    """
    e = _checkpoint(edges.select(*keys, "src", "dst").distinct())
    sources, sinks = first_ends(e, *keys, count=count)
    far = _checkpoint(sinks.select(*keys, F.col("node").alias("target"), "node", F.lit(0).alias("far")))
    every, level = far, far
    for d in range(1, max_edges + 1):
        back = level.join(_long(e.withColumnRenamed("dst", "node")), [*keys, "node"]).select(*keys, "target", F.col("src").alias("node")).distinct()
        level = _checkpoint(back.join(_long(every), [*keys, "target", "node"], "left_anti").withColumn("far", F.lit(d)))
        if level.isEmpty():
            break
        every = every.union(level)
    every = _checkpoint(every)
    state = sources.join(_long(every), [*keys, "node"]).where(F.col("far") > 0)
    state = state.select(*keys, F.col("node").alias("source"), "target", F.col("node").alias("at"), F.array("node").alias("path"))
    found = None
    for d in range(1, max_edges + 1):
        grown = state.join(_long(e.withColumnRenamed("src", "at")), [*keys, "at"]).where(~F.array_contains("path", F.col("dst")))
        grown = grown.join(_long(every.withColumnRenamed("node", "dst")), [*keys, "target", "dst"]).where(F.col("far") <= max_edges - d)
        state = _checkpoint(grown.select(*keys, "source", "target", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path")))
        done = state.where("at = target")
        found = done if found is None else found.union(done)
        state = state.where("at <> target")
        if state.isEmpty():
            break
    hops = found.select(*keys, "source", "target", "path", F.posexplode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("src"), F.slice("path", F.lit(2), F.size("path")).alias("dst"))).alias("k", "h"))
    named = hops.select(*keys, "source", "target", "path", "k", "h.src", "h.dst").join(_long(edges.select(*keys, "src", "dst", "calls")), [*keys, "src", "dst"])
    calls = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "calls"))), lambda x: x["calls"])).alias("calls")
    rows = named.groupBy(*keys, "source", "target", "path").agg(calls)
    return rows.withColumn("depth", F.size("path") - 1)


def file_flows(files_stats: DataFrame, facts: DataFrame) -> DataFrame:
    """Per Python file: functions, calls, the measures of its call graph, entry points, cycles and whether it failed to parse.

    entry_points: callers that nothing in the file calls. cycles: each once, from its least node.
    A file that doesn't parse has only nulls and its flag; one without calls has no measures.
    files_stats: see pyast.file_stats; facts: see pyast.file_facts.
    """
    key = ["repo_id", "path"]
    facts = _checkpoint(facts.where("kind IN ('function', 'call')").select(*key, "kind", "name", "caller", "line"))  # made once
    calls = _checkpoint(graph.call_edges(facts))
    counts = facts.groupBy(*key).agg(F.sum((F.col("kind") == "function").cast("long")).alias("functions"), F.sum((F.col("kind") == "call").cast("long")).alias("calls"))
    pointed = calls.select(*key, F.col("dst").alias("src")).distinct()
    entry = calls.select(*key, "src").distinct().join(_long(pointed), [*key, "src"], "left_anti").groupBy(*key).agg(F.array_sort(F.collect_list("src")).alias("entry_points"))
    # nodes carry their file, so that one search finds the cycles of all files
    node = lambda c: F.struct("repo_id", "path", F.col(c).alias("name")).alias(c)
    loops = graph.cycles(calls.select(node("src"), node("dst")))
    loops = loops.select(F.col("cycle")[0]["repo_id"].alias("repo_id"), F.col("cycle")[0]["path"].alias("path"), F.transform("cycle", lambda x: x["name"]).alias("cycle"))
    loops = loops.groupBy(*key).agg(F.array_sort(F.collect_list("cycle")).alias("cycles"))
    rows = files_stats.select(*key, "parse_error")
    for part in (counts, graph.call_graphs(calls), entry, loops):
        rows = rows.join(_long(part), key, "left")
    parsed, none = ~F.col("parse_error"), F.expr("cast(array() AS array<string>)")
    return rows.withColumns({
        "functions": F.when(parsed, F.coalesce("functions", F.lit(0))), "calls": F.when(parsed, F.coalesce("calls", F.lit(0))),
        "entry_points": F.when(parsed, F.coalesce("entry_points", none)), "cycles": F.when(parsed, F.coalesce("cycles", F.array().cast("array<array<string>>"))),
    })
