"""Versions of a dependency graph: names encoded as dense numbers, edges by number, differences between versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph
from .graph import _checkpoint


def dictionary(names: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """name and id of every name: 0, 1, ... in the order of the names.

    With a dictionary of an earlier version its names keep their ids, and new ones go on behind
    them, in order among themselves. Names are sorted by ranges; a task numbers its own range, and only
    the ranges' sizes meet, so no window or task sees all names.
    """
    names = names.select("name").where(F.col("name").isNotNull()).distinct()
    start = 0
    if known is not None:
        names = names.join(known.select("name"), "name", "left_anti")
        last = known.agg(F.max("id")).first()[0]
        start = 0 if last is None else last + 1
    ranged = names.repartitionByRange("name").sortWithinPartitions("name")
    # a row's place within its task, and the task, as they are written
    ranged = _checkpoint(ranged.select("name", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row for each task
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    new = ranged.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select("name", (F.col("before") + F.col("place") + start).alias("id"))
    return new if known is None else known.select("name", "id").union(new)


def save(edges: DataFrame, folder: str, version: int, isolated: DataFrame | None = None, previous: int | None = None) -> None:
    """Writes nodes, edges and metrics of a graph under folder/version=N.

    edges: src, dst (names), weight, type; isolated: name of nodes without an edge, which are kept.
    previous: the version whose ids its names keep. The metrics come last: a version with them is whole.
    """
    spark = edges.sparkSession
    at = f"{folder}/version={version}"
    edges = _checkpoint(edges)  # read for both ends' names and for their numbers, made once
    names = edges.select(F.col("src").alias("name")).union(edges.select("dst"))
    names = names if isolated is None else names.union(isolated.select("name"))
    known = None if previous is None else spark.read.parquet(f"{folder}/version={previous}/dictionary")
    names = _checkpoint(names.distinct())
    dictionary(names, known).write.mode("overwrite").parquet(f"{at}/dictionary")
    ids = spark.read.parquet(f"{at}/dictionary")
    names.join(ids, "name").select("id").write.mode("overwrite").parquet(f"{at}/nodes")
    numbered = edges.join(ids.select(F.col("name").alias("src"), F.col("id").alias("src_id")), "src").join(ids.select(F.col("name").alias("dst"), F.col("id").alias("dst_id")), "dst")
    numbered.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "weight", "type").write.mode("overwrite").parquet(f"{at}/edges")
    saved = spark.read.parquet(f"{at}/edges")
    graph.graph_metrics(saved.select("src", "dst")).write.mode("overwrite").parquet(f"{at}/metrics")


def load(spark: SparkSession, folder: str, version: int) -> tuple[DataFrame, DataFrame]:
    """The nodes (name, id) and edges (src, dst, weight, type; by name) of a version."""
    at = f"{folder}/version={version}"
    ids = spark.read.parquet(f"{at}/dictionary")
    nodes = ids.join(spark.read.parquet(f"{at}/nodes"), "id", "left_semi").select("name", "id")
    name = lambda c: ids.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    edges = spark.read.parquet(f"{at}/edges").join(name("src"), "src").join(name("dst"), "dst")
    return nodes, edges.select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "weight", "type")


def load_plain(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """Only source, target and weight of a version's edges, all of one type, without isolated nodes: what an exchange file keeps."""
    _, edges = load(spark, folder, version)
    return edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "weight", F.lit("MODULE_REFERENCE").alias("type"))


def metrics(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/version={version}/metrics")


def difference(spark: SparkSession, folder: str, old: int, new: int) -> DataFrame:
    """src, dst, status (added, removed, changed), old_weight and new_weight of the edges in which two versions differ.

    The new version must have been saved with the old one, or one after it, as previous: then
    edges are compared by number, and names are looked up for those that differ only.
    """
    def side(version: int, name: str) -> DataFrame:
        rows = spark.read.parquet(f"{folder}/version={version}/edges")
        return rows.groupBy("src", "dst").agg(F.sum("weight").alias(name))

    both = side(old, "old_weight").join(side(new, "new_weight"), ["src", "dst"], "full")
    status = F.when(F.col("old_weight").isNull(), "added").when(F.col("new_weight").isNull(), "removed").when(F.col("old_weight") != F.col("new_weight"), "changed")
    rows = both.withColumn("status", status).where(F.col("status").isNotNull())
    ids = spark.read.parquet(f"{folder}/version={new}/dictionary")
    rows = rows.join(ids.select(F.col("id").alias("src"), F.col("name").alias("src_name")), "src").join(ids.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst")
    return rows.select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "status", "old_weight", "new_weight")


def description(edges: DataFrame, max_cycles: int = 100) -> DataFrame:
    """part, ord and value (JSON) of everything about a graph: nodes, edges, cycles, metrics, suggestions and its DOT lines.

    edges: src, dst, weight, type. Rows come as they are found; ord sorts each part.
    """
    e = edges.select("src", "dst")
    row = lambda df, part, *order: df.select(F.lit(part).alias("part"), F.struct(*order).cast("string").alias("ord"), F.to_json(F.struct("*")).alias("value"))
    loops = graph.cycles(e).orderBy("cycle").limit(max_cycles)
    heading = edges.sparkSession.createDataFrame([("0", "digraph dependencies {"), ("2", "}")], "place string, line string")
    lines = heading.union(graph.dot(edges).select(F.lit("1"), "line"))
    return (
        row(graph.nodes(e).withColumnRenamed("node", "name"), "node", "name").union(row(edges, "edge", "src", "dst", "type")).union(row(loops, "cycle", "cycle"))
        .union(row(graph.graph_metrics(e), "metrics", "nodes")).union(row(graph.refactoring(e), "suggestion", "type", "node")).union(row(lines, "dot", "place", "line"))
    )
