"""Mixing sources to target weights over a training run, as a curriculum that varies in time.

Each source has a schedule: its weight over training time 0 to 1, piecewise linear. The
integral of the schedule is the source's weight in the mix; its running integral, scaled to
the source's target, is the source's cumulative demand for words. Documents of a source lie
end to end in a fixed shuffled order; a copy of a document is read when the demand reaches
its middle, so inverting the demand gives its training position, and one range sort by
position gives the order of the run.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, bucket_count, materialize, running_total

#: Integrals 3, 1 and 2: the first kind fades out, the others come in.
SCHEDULES = (((0.0, 4.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (0.5, 2.0), (1.0, 3.0)))


def weight(schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))


def position(schedule, share: Column) -> Column:
    """The time at which the running integral reaches this share (0 to 1) of the whole."""
    whole, before, out = weight(schedule), 0.0, None
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        area = (t1 - t0) * (w0 + w1) / 2
        need, slope = share * whole - before, (w1 - w0) / (t1 - t0)
        # the root of w0 x + slope x^2 / 2 = need that stays finite when slope or w0 is zero
        x = F.when(need <= 0, 0.0).otherwise(2 * need / (w0 + F.sqrt(F.greatest(w0 * w0 + 2 * slope * need, F.lit(0.0)))))
        t = F.lit(t0) + F.least(x, F.lit(t1 - t0))
        out = t if out is None else F.when(share * whole <= before, out).otherwise(t)
        before += area
    return out


def global_index(df: DataFrame, *order: Column) -> DataFrame:
    """Adds index: the row's place in the order, from 0, by a range sort and per-partition counts."""
    rows = materialize(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftrightunsigned("_id", 33)).withColumn("_row", F.expr("_id & ((1L << 33) - 1)"))
    # one row per partition
    starts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return rows.join(starts, "_part").withColumn("index", F.col("_start") + F.col("_row")).drop("_id", "_part", "_row", "_start")


def targets(sizes: DataFrame, schedules=SCHEDULES, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, documents, kind (its schedule's number) and target.

    The targets share `share` of all words by the schedules' weights, dealt to the sources in
    code point order (null last); what exceeds `most` times a source's size is reshared by
    weight until nothing does. Each round is one aggregation of the sources to three numbers.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    sources = global_index(sources, F.col("source").asc_nulls_last())
    weights = [weight(s) for s in schedules]
    kind = F.col("index") % len(schedules)
    w = F.element_at(F.array(*map(F.lit, weights)), (kind + 1).cast("int"))
    sources = materialize(sources.select("source", "source_size", "documents", kind.cast("int").alias("kind"), w.alias("weight")))
    full = F.col("source_size") * most
    words, all_weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted = share * (words or 0)
    level, open_ = wanted / (all_weights or 1), None  # words for one unit of weight
    while True:
        capped = full <= F.col("weight") * level
        spent, rest, n = sources.agg(
            F.sum(F.when(capped, full)), F.sum(F.when(~capped, F.col("weight"))), F.sum(F.when(~capped, 1))
        ).first()
        if n == open_ or not rest:
            break
        level, open_ = (wanted - (spent or 0.0)) / rest, n
    return sources.select("source", "source_size", "documents", "kind", F.least(full, F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, carry: tuple[str, ...] = (), schedules=SCHEDULES, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken, position, positions, then the carried
    columns of docs (carried_0 and so on).

    size: words of the text (null: 0). taken: words that the mix takes, repeats counted; the
    document on the edge of its source's target is taken in part, so a source's words meet its
    target to a word, and none exceeds `most` (rounded up to whole passes) times its size.
    position: training time of the first copy, null if none; positions: of each copy, taken
    whole or in part, in order. Documents of a source follow a hash
    of doc_id; rows that repeat are documents of their own; a null source is a source; an empty
    table gives an empty result; columns that aren't carried are ignored.
    """
    column = {c: F.col(f"`{c.replace('`', '``')}`") for c in carry}
    sizes = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *(column[c].alias(f"carried_{k}") for k, c in enumerate(carry)),
    )
    if not carry:
        sizes = materialize(sizes)
    plan = targets(sizes.select("source", "size"), schedules, share, most)
    buckets = bucket_count(plan.agg(F.sum("documents")).first()[0] or 0, least=1024)
    # a null source is a key of its own
    key = F.coalesce(F.concat(F.lit("v"), "source"), F.lit("n"))
    order = [F.col("_h"), F.col("doc_id"), F.col("size")]
    rows = sizes.withColumn("_h", F.xxhash64("doc_id", F.lit("mix"))).withColumn("_source", key)
    rows = running_total(rows, ["_source"], order, F.col("size"), F.shiftright("_h", 65 - buckets.bit_length()))
    rows = rows.join(plan.withColumn("_source", key).drop("source"), "_source")
    words = F.floor(F.col("target") + 0.5)
    passes = [F.greatest(F.lit(0), F.least(F.col("size"), words - F.col("before") - F.col("source_size") * k)) for k in range(ceil(most))]
    taken = passes[0]
    for p in passes[1:]:
        taken = taken + p
    times = []
    for k, p in enumerate(passes):
        middle = F.least(F.lit(1.0), (F.col("before") + F.col("source_size") * k + F.col("size") / 2) / F.col("target"))
        when = F.element_at(F.array(*(position(s, middle) for s in schedules)), F.col("kind") + 1)
        times.append(F.when(p > 0, when))
    return rows.withColumn("taken", taken).select(
        "doc_id", "source", "size", "source_size", "target", "taken", times[0].alias("position"),
        F.array_compact(F.array(*times)).alias("positions"), *(f"carried_{k}" for k in range(len(carry))),
    )


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """mix() in the order of the run: range-sorted by position, documents not taken last."""
    return mix(docs, **options).orderBy(F.col("position").asc_nulls_last(), "doc_id")
