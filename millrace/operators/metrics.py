"""Repository metrics, banded scores and recommendations. Content never leaves the scan stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import paths, rules


def file_facts(files: DataFrame) -> DataFrame:
    """Narrow facts of each file; everything else aggregates these."""
    path, ext = F.col("path"), paths.extension(F.col("path"))
    counted = F.when(ext.isin(*rules.COUNTED), paths.iterated_lines(F.col("content"))).otherwise(F.lit(0)).cast("long")
    return files.select(
        "repo_id", "path", F.col("size_bytes").cast("long").alias("size_bytes"), ext.alias("ext"), counted.alias("lines"),
        paths.category(path).alias("category"), paths.metric_language(path).alias("language"), paths.layer(path).alias("layer"),
    )


def code_metrics(facts: DataFrame) -> DataFrame:
    """One row per repository; unrounded. One scan: sums by category first, then by repository."""
    large = F.col("lines") > 1000
    kinds = facts.groupBy("repo_id", "category").agg(
        F.count("*").alias("n"), F.sum("lines").alias("lines"), F.sum("size_bytes").alias("bytes"), F.sum(large.cast("long")).alias("large"),
        F.sum(F.when(large, F.col("lines"))).alias("large_lines"), F.collect_set(F.when(F.col("language") != "", F.col("language"))).alias("languages"),
    )
    out = kinds.groupBy("repo_id").agg(
        F.sum("n").alias("file_count"), F.sum("lines").alias("total_lines"), F.sum("bytes").alias("total_bytes"), F.sum("large").alias("large_files"),
        F.coalesce(F.sum("large_lines"), F.lit(0)).alias("large_lines"), F.array_distinct(F.flatten(F.collect_list("languages"))).alias("all"),
        F.max("n").alias("main_type_count"),
    )
    names = {"languages": F.array_join(F.array_sort("all"), ","), "language_count": F.size("all").cast("long")}
    return out.withColumns(names).drop("all")


def band(value: Column, *steps: tuple[float, int]) -> Column:
    """Points of the first step that the value is above."""
    out = None
    for over, points in steps:
        out = F.when(value > over, points) if out is None else out.when(value > over, points)
    return out.otherwise(0)


def level(score: Column) -> Column:
    return (
        F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 40, "medium").when(score >= 20, "low").otherwise("none")
    )


def metric_score() -> Column:
    """Points over the columns of code_metrics."""
    n = F.col("file_count")
    return F.least(F.lit(100), (
        band(n, (1000, 20), (500, 15), (200, 10), (100, 5))
        + band(F.col("large_files") * 100.0 / n, (20, 25), (10, 15), (5, 10), (0, 5))
        + band(F.col("language_count"), (5, 15), (3, 10), (1, 5))
        + band(F.col("main_type_count") / n, (0.8, 20), (0.6, 15), (0.4, 10))
        + F.when(F.col("large_files") > 0, band(F.col("large_lines") / F.col("large_files"), (2000, 20), (1000, 15), (500, 10))).otherwise(0)
    ))


def metric_risk(metrics: DataFrame) -> DataFrame:
    return metrics.select("repo_id", metric_score().alias("risk_score"), level(metric_score()).alias("risk"))


def language_share(files: DataFrame) -> DataFrame:
    """Files of each language and their share of all files; rank 1 is the primary language."""
    rows = files.select("repo_id", paths.report_language(F.col("path")).alias("language"))
    counts = rows.groupBy("repo_id", "language").agg(F.count("*").alias("n"))
    share = counts.withColumn("percentage", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("repo_id")))
    order = W.partitionBy("repo_id").orderBy(F.desc("n"), "language")
    return share.where("language <> ''").withColumn("rank", F.row_number().over(order))


def tier() -> tuple[Column, Column]:
    """Level and score over secrets_found, vulnerabilities_found and critical_count."""
    c, v, s = F.col("critical_count"), F.col("vulnerabilities_found"), F.col("secrets_found")
    name = F.when(c > 0, "critical").when(v > 0, "high").when(s > 5, "medium").when(s > 0, "low").otherwise("none")
    score = F.when(c > 0, 90).when(v > 0, 70).when(s > 5, 50).when(s > 0, 30).otherwise(0)
    return name, score


def security_tier(counts: DataFrame) -> DataFrame:
    name, score = tier()
    return counts.select("repo_id", name.alias("risk_level"), score.alias("risk_score"))


def overall_risk(counts: DataFrame) -> DataFrame:
    """counts as above, and avg_complexity, file_count."""
    score = F.least(F.lit(100), (
        F.least(F.col("secrets_found") * 2, F.lit(20)) + F.least(F.col("vulnerabilities_found") * 5, F.lit(20))
        + F.least(F.col("critical_count") * 10, F.lit(10)) + band(F.col("avg_complexity"), (50, 20), (20, 10), (10, 5))
        + band(F.col("file_count"), (1000, 15), (500, 10), (100, 5))
    )).cast("int")
    return counts.select("repo_id", score.alias("risk_score"), level(score).alias("risk_level"))


def recommendations(counts: DataFrame) -> DataFrame:
    """A row per rule that holds: category, priority, title, description, action."""
    about = {
        "secrets": ("secrets_found", 0), "vulnerabilities": ("vulnerabilities_found", 0), "critical": ("critical_count", 0),
        "complexity": ("avg_complexity", 20), "size": ("file_count", 1000),
    }

    def row(name: str) -> Column:
        column, over = about[name]
        category, priority, title, description, action = rules.RECOMMENDATIONS[name]
        said = F.replace(F.lit(description), F.lit("%s"), F.col(column).cast("string"))
        fields = {"category": F.lit(category), "priority": F.lit(priority), "title": F.lit(title), "description": said, "action": F.lit(action)}
        return F.when(F.col(column) > over, F.struct(*(v.alias(k) for k, v in fields.items())))

    rows = F.filter(F.array(*map(row, about)), lambda r: r.isNotNull())
    return counts.select("repo_id", F.explode(rows).alias("r")).select("repo_id", "r.*")


def rounded(metrics: DataFrame) -> DataFrame:
    """The figures that a report shows: sizes in KB and means per file, to two places."""
    n = F.col("file_count")
    return metrics.select(
        "repo_id", F.round(F.col("total_bytes") / 1024, 2).alias("total_kb"), F.round(F.col("total_bytes") / 1024 / n, 2).alias("avg_kb"),
        F.round(F.col("total_lines") / n, 2).alias("avg_lines"),
    )


def throughput(metrics: DataFrame, seconds: Column) -> DataFrame:
    """Files a second of analyses that took some time."""
    return metrics.select("repo_id", "file_count", "total_bytes", F.when(seconds > 0, F.col("file_count") / seconds).otherwise(0.0).alias("files_per_second"))
