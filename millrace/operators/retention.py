"""What retention deletes: a table of policies by kind of item, applied in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules

POLICY = "policy string, kind string, max_hours bigint, keep_last int, floor_hours bigint"


def policies(spark: SparkSession, days: int | None = None) -> DataFrame:
    """The fixed policies; days replaces the age of those that follow a common setting, each no less than its floor."""
    rows = []
    for name, kind, hours, keep, times, floor in rules.RETENTION:
        if days is not None and times:
            hours = max(days * 24 * times, floor)
        rows.append((name, kind, hours, keep, floor))
    return spark.createDataFrame(rows, POLICY)


def deletions(items: DataFrame, ruled: DataFrame, now: Column) -> DataFrame:
    """The items that a policy deletes, a row for each policy that does: policy, kind, item, size_bytes, modified, age_hours and reason.

    items: kind, item, size_bytes, modified. An item goes when it was changed more than max_hours
    before now (reason age), or when keep_last newer ones of its kind stand before it (reason
    count; of equal times the lesser item is newer). A null modified counts as never old, and as
    oldest in the order. The policies are a table of a few rows; the newest of each kind are cut
    per task before they meet, so the older items of a kind never sort in one task.
    """
    few = F.broadcast(ruled)  # a row for each policy
    rows = items.join(few, "kind").withColumn("age_hours", (F.unix_micros(now) - F.unix_micros(F.col("modified").cast("timestamp"))) / 3.6e9)
    old = F.col("max_hours").isNotNull() & (F.col("age_hours") > F.col("max_hours"))
    counted = rows.where(F.col("keep_last").isNotNull())
    most = max([r.keep_last for r in ruled.where("keep_last IS NOT NULL").select("keep_last").collect()], default=0)  # of a few rows
    rank = F.row_number().over(W.partitionBy("policy").orderBy(F.desc_nulls_last("modified"), "item"))
    kept = counted.select("policy", "item", "modified", "keep_last").withColumn("rank", rank).where(F.col("rank") <= most).where(F.col("rank") <= F.col("keep_last"))
    kept = kept.select("policy", "item", F.lit(True).alias("newest"))
    marked = rows.join(kept, ["policy", "item"], "left")
    beyond = F.col("keep_last").isNotNull() & F.col("newest").isNull()
    reason = F.when(F.coalesce(old, F.lit(False)), "age").when(beyond, "count")
    return marked.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("policy", "kind", "item", "size_bytes", "modified", "age_hours", "reason")


def totals(deleted: DataFrame) -> DataFrame:
    """Per policy: how many items go, by age and by count, and the bytes that frees."""
    by = lambda r: F.sum((F.col("reason") == r).cast("long"))
    return deleted.groupBy("policy").agg(F.count("*").alias("deleted"), by("age").alias("by_age"), by("count").alias("by_count"), F.sum("size_bytes").alias("freed_bytes"))
