"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: White space between words, the same six bytes that bytes.split() takes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the cluster's shared folder.

    The folder is the session's spark.checkpoint.dir. Without one only a local session gets a
    temporary folder of its own; on a cluster its executors would write where nobody else reads.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not (sc.master.startswith("local") and "cluster" not in sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="millrace-checkpoint-"))
    return df.checkpoint(eager=True)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """materialize(), and the number of rows; few rows are read in few tasks."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")))
    n = seen.get["n"]
    return in_few(out, n), n


def in_few(df: DataFrame, rows: int, rows_each: int = 1 << 14) -> DataFrame:
    """A written table whose partitions hold far fewer than rows_each rows, in as many as those rows fill.

    Every task that reads a part of a table writes files of its own for each shuffle; a round over
    thousands of rows would write thousands of small files. Never fewer than the cores.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_each))
    return df.coalesce(parts) if df.rdd.getNumPartitions() > 2 * parts else df


@contextmanager
def planned(spark: SparkSession, rows: int, rows_each: int = 200_000):
    """Plans what runs inside for a known number of rows: so many partitions, not re-planned as it runs.

    Short rounds of small joins gain nothing from adaptive execution, which runs every exchange as
    a job of its own and keeps a thread of the driver for it for a minute. For plans whose rows no
    hot key gathers; adaptive execution stays on for all others.
    """
    conf = spark.conf
    new = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(max(spark.sparkContext.defaultParallelism, -(-rows // rows_each)))}
    old = {k: conf.get(k) for k in new}
    try:
        for k, v in new.items():
            conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            conf.set(k, v)


def release(spark: SparkSession) -> None:
    """Has the driver drop what is out of scope, so that Spark's cleaner deletes its shuffle files and checkpoints.

    Spark only notices at the driver's own collections, which a long chain of steps with a small driver
    heap doesn't bring about; the files of all steps would stay on disk until its end.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release_if_grown(spark: SparkSession) -> None:
    """release() once the driver's heap holds over 3/5 of what it may: rounds leave plans and task records behind,
    and a heap that has grown to its limit only shrinks by a collection that is asked for."""
    heap = spark.sparkContext._jvm.Runtime.getRuntime()
    if 5 * heap.totalMemory() > 3 * heap.maxMemory():
        release(spark)


_held: dict = {}


def held(kind: str, key, make):
    """What a Python worker keeps between batches and tasks: one thing, of the operator that used the worker last.

    Spark hands its workers on from stage to stage; what every operator keeps would add up in each.
    Call it from a function of a module: a nested one is sent with copies of its globals.
    """
    if (kind, key) not in _held:
        _held.clear()
        _held[kind, key] = make()
    return _held[kind, key]


def map_batches(df: DataFrame, fn, schema: str, where=None) -> DataFrame:
    """mapInArrow with a function from one pandas-free column dict to another.

    fn takes an iterator of dicts (column name to list) and yields dicts. where: a column's name and
    a function over it, as Arrow arrays, to whether fn gets the row; a filter of its own before
    the map would hold a second Python worker for each task.
    """
    ship(df.sparkSession)
    names = df.columns
    arrow = pa.schema([(f.name, _arrow_type(f.dataType)) for f in T._parse_datatype_string(schema).fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = batches if where is None else (b.filter(where[1](b.column(where[0]))) for b in batches)
        inputs = ({n: b.column(i).to_pylist() for i, n in enumerate(names)} for b in kept)
        for out in fn(inputs):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow_type(t.elementType))
    return {
        T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.DoubleType: pa.float64(),
        T.BooleanType: pa.bool_(), T.BinaryType: pa.binary(), T.FloatType: pa.float32(),
    }[type(t)]


def arrow_function(fn, returns: str):
    """A column function from one over Arrow arrays (no pandas in the workers)."""

    def call(*columns: pa.Array) -> pa.Array:
        return fn(*columns)

    return F.arrow_udf(call, returns)


def member_filter(keys: DataFrame, column: str, most_bits: int = 1 << 25):
    """member_test() as a function over columns."""
    member = member_test(keys, column, most_bits)
    return (lambda x: F.lit(True)) if member is None else arrow_function(member, "boolean")


def member_test(keys: DataFrame, column: str, most_bits: int = 1 << 25):
    """A function from an Arrow array of longs to whether they may be among the keys (a Bloom filter).

    Never false for a key; true for some others, so it only serves to keep rows from a shuffle.
    Its size follows the number of keys up to most_bits (4 MB), so it can be broadcast; with more
    keys than it can tell apart it is left out (None) and every row counts as a possible member.
    """
    import numpy as np

    n = keys.count()
    if n > most_bits // 6:
        return None
    bits = 1 << 13
    while bits < 12 * n:
        bits *= 2
    bits = min(bits, most_bits)

    def places(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int64).view(np.uint64)
        out = []
        for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
            h = (x ^ x >> np.uint64(31)) * np.uint64(seed)
            h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            out.append(h >> np.uint64(32) & np.uint64(bits - 1))
        return np.concatenate(out).astype(np.int64)

    def words(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            p = np.unique(places(np.array(b[column], np.int64)))
            word, start = np.unique(p >> 5, return_index=True)
            set_ = np.add.reduceat(1 << (p & 31), start) if len(p) else p
            yield {"word": word, "set": set_.astype(np.uint32).view(np.int32)}

    # at most bits / 32 rows
    got = map_batches(keys.select(column), words, "word int, set int").groupBy("word").agg(F.bit_or("set").alias("set")).toArrow()
    table_ = np.zeros(bits >> 5, np.uint32)
    table_[got["word"].to_numpy()] = got["set"].to_numpy().view(np.uint32)
    sent = keys.sparkSession.sparkContext.broadcast(table_)

    def member(x: pa.Array) -> pa.Array:
        p = places(x.to_numpy(zero_copy_only=False))
        hit = (sent.value[p >> 5] >> (p & 31).astype(np.uint32) & 1).reshape(3, -1).all(axis=0)
        return pa.array(hit)

    return member


def connected_components(nodes_edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The smallest reachable node of every node that has an edge.

    nodes_edges has columns a and b (longs, one row per link, either direction, copies
    allowed). Returns node and root. Alternates large-star and small-star steps: each
    keeps at most as many edges as before and links a node to the minimum of its
    neighbourhood, so the rounds grow with the logarithm of the longest path. A hub's
    neighbourhood is only ever reduced by a partial minimum and streamed past it in a join on two
    longs a row; it is never collected. Loops only on a count.
    """
    spark = nodes_edges.sparkSession
    links = nodes_edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, before = _observed(links.distinct())
    for _ in range(max_rounds):
        if not before[0]:
            break
        with planned(spark, 2 * before[0]):
            large = _to_least(_ends(edges, (("a", "b"), ("b", "a")))).where("b > a and b > m")
            small = _to_least(large.select(F.col("b").alias("a"), F.col("m").alias("b")))
            edges, after = _observed(_ends(small, (("a", "m"), ("b", "m"))).where("a > b").distinct())
        if after == before:
            break
        before = after
        del large, small
        release_if_grown(spark)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    release(spark)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _ends(rows: DataFrame, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """a and b of each row by the pairs of columns named."""
    ends = F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs))
    return rows.select(F.explode(ends).alias("e")).select("e.a", "e.b")


def _to_least(rows: DataFrame) -> DataFrame:
    """a, b and m: the least of a and all its b; one shuffle."""
    rows = rows.repartition("a")
    return rows.join(rows.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "a")


def _observed(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written out, and two sums over them that came along: equal only at the fixed point."""
    seen = Observation()
    hashes = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("hashes")
    edges = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), hashes))
    return in_few(edges, seen.get["n"]), (seen.get["n"], seen.get["hashes"])


def bucket_count(n: int, rows_each: int = 1 << 16, least: int = 64) -> int:
    """A power of two of buckets that hold some rows_each rows of a key that holds them all."""
    buckets = least
    while buckets * rows_each < n:
        buckets *= 2
    return buckets


def running_total(df: DataFrame, keys: list[str], order: list[Column], value: Column, bucket: Column) -> DataFrame:
    """Adds `before`: the sum of value over earlier rows of the same keys.

    Rows go to windows by keys and bucket, never by keys alone, so a key that holds a third
    of the table spreads out; the buckets' own totals (one row for each key and bucket) give
    each bucket its start. No key may be null. bucket must not decrease along order; take as many as bucket_count says.
    """
    from pyspark.sql import Window as W

    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum"))
    w = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_start"))
    w = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.join(sums, [*keys, "_bucket"])
        .withColumn("before", F.col("_start") + F.coalesce(F.sum("_value").over(w), F.lit(0)))
        .drop("_bucket", "_value", "_start")
    )
