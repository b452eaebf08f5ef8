"""Queries over stored analyses, reports, findings, exports, settings and webhooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scan import severity_rank


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page in a total order: sort and limit become one top-k per partition, then one merge."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_info(total: Column, offset: int, limit: int) -> list[Column]:
    return [
        total.alias("total"), (F.lit(offset + limit) < total).alias("has_more"),
        F.ceil(total / limit).cast("long").alias("total_pages"), F.lit(offset // limit + 1).alias("current_page"),
    ]


def search_reports(
    reports: DataFrame, analyses: DataFrame, text: str | None = None, status: str | None = None, min_score: float | None = None,
    max_score: float | None = None, since=None, until=None, user_id: int | None = None,
) -> DataFrame:
    """Reports with their analysis, filtered. Bounds count only if given; a missing score is 0 for the lower, 100 for the upper bound."""
    rows = reports.join(analyses, "analysis_id")
    if text:
        rows = rows.where(F.col("repo_name").ilike(f"%{text}%") | F.col("summary").ilike(f"%{text}%"))
    if status:
        rows = rows.where(F.col("status") == status)
    if min_score is not None:
        rows = rows.where(F.coalesce("risk_score", F.lit(0.0)) >= min_score)
    if max_score is not None:
        rows = rows.where(F.coalesce("risk_score", F.lit(100.0)) <= max_score)
    if since:
        rows = rows.where(F.to_date("created_at") >= F.lit(since).cast("date"))
    if until:
        rows = rows.where(F.to_date("created_at") <= F.lit(until).cast("date"))
    if user_id:
        rows = rows.where(F.col("user_id") == user_id)
    return rows


def findings_of(findings: DataFrame, analyses: DataFrame, severity: str | None = None, limit: int = 1000) -> DataFrame:
    rows = findings.join(analyses.select("analysis_id"), "analysis_id", "left_semi")
    if severity:
        rows = rows.where(F.col("severity") == severity)
    return rows.orderBy(F.desc("risk_score"), F.desc(severity_rank(F.col("severity"))), "finding_id").limit(limit)


def with_reports(analyses: DataFrame, reports: DataFrame) -> DataFrame:
    """Every analysis with its report, if it has one."""
    return analyses.join(reports, "analysis_id", "left")


def by_either_key(rows: DataFrame, asked: DataFrame, number: str, uuid: str) -> DataFrame:
    """The rows that asked (one column key, text) names by their number or their uuid, with the key.

    Each kind of key is an equi-join of its own; a row that both name comes twice.
    """
    numbers = asked.where(F.col("key").rlike("^[0-9]{1,18}$")).select("key", F.col("key").cast("long").alias("_k"))
    by_number = rows.join(numbers, rows[number] == numbers["_k"]).drop("_k")
    others = asked.where(~F.col("key").rlike("^[0-9]{1,18}$"))
    return by_number.unionByName(rows.join(others, rows[uuid] == others["key"]))


def updated(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows with what changes has for them; a null in changes leaves a value as it is."""
    new = [c for c in changes.columns if c != key]
    given = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in new))
    joined = rows.join(given, key, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in new else c for c in rows.columns))


def report_catalogue(reports: DataFrame, analyses: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """The newest reports with what a list shows of them; missing values have defaults."""
    rows = with_reports(analyses, reports).where(F.col("report_id").isNotNull())
    rows = rows.select(
        "report_id", "analysis_id", F.coalesce("repo_name", F.lit("Unknown")).alias("title"), F.coalesce("risk_level", F.lit("unknown")).alias("risk_level"),
        F.length("summary").cast("long").alias("size_bytes"), "created_at",
    )
    return page(rows, [F.desc("created_at"), F.col("report_id")], offset, limit)


def summary_projection(analyses: DataFrame) -> DataFrame:
    """The flat summary of every analysis; what it lacks is zero, 'unknown' or false."""
    return analyses.select(
        "analysis_id", F.coalesce("repo_name", F.lit("Unknown")).alias("repository"), F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce("risk_level", F.lit("unknown")).alias("risk_level"), F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
        F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("duration_seconds", F.lit(0)).alias("duration_seconds"),
        (F.col("risk_level").isNotNull()).alias("scored"),
    )


def usage(events: DataFrame) -> DataFrame:
    """Calls, users and errors of each endpoint and day. events: user_id, endpoint, created_at, failed."""
    return events.groupBy("endpoint", F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("calls"), F.countDistinct("user_id").alias("users"), F.sum(F.col("failed").cast("long")).alias("errors")
    )


def cleanup_totals(rows: DataFrame, now: Column) -> DataFrame:
    """What a sweep deletes of each target: rows and bytes. rows: target, size_bytes, expires_at."""
    return expired(rows, now).groupBy("target").agg(F.count("*").alias("deleted"), F.sum("size_bytes").alias("freed_bytes"))


def analysis_stats(analyses: DataFrame, user_id: int | None = None, since=None) -> DataFrame:
    """Counts by status, by risk level and in all; means over the durations that aren't zero and over
    all files. Only of one user, only from a time on, if given."""
    if user_id is not None:
        analyses = analyses.where(F.col("user_id") == user_id)
    if since is not None:
        analyses = analyses.where(F.col("created_at") >= F.lit(since).cast(analyses.schema["created_at"].dataType))
    return analyses.withColumn("risk_level", F.coalesce("risk_level", F.lit("unknown"))).groupingSets(
        [["status"], ["risk_level"], []], "status", "risk_level"
    ).agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("duration_seconds") != 0, F.col("duration_seconds"))).alias("avg_duration"),
        F.sum("file_count").alias("files"),
    )


def webhooks_for(webhooks: DataFrame, event: str) -> DataFrame:
    return webhooks.where(F.col("is_active") & F.array_contains("events", event))


def latest_settings(changes: DataFrame) -> DataFrame:
    """key and value of the last change of each key (ties: greater id), without deleted ones (null value)."""
    last = changes.groupBy("key").agg(F.max_by("value", F.struct("ts", "id")).alias("value"))
    return last.where(F.col("value").isNotNull())


def expired(rows: DataFrame, now: Column, column: str = "expires_at") -> DataFrame:
    return rows.where(F.col(column) <= now)


def beyond_last(rows: DataFrame, keep: int, key: str, order: list[tuple[str, bool]]) -> DataFrame:
    """Rows of each key behind the newest `keep` of them: what a retention sweep deletes.

    order: columns and whether they descend; with key they tell rows apart and aren't null. The
    newest are found by a rank that each task cuts at `keep` before anything is shuffled; the
    others never meet in one sort.
    """
    names = [key, *(c for c, _ in order)]
    rank = F.row_number().over(W.partitionBy(key).orderBy(*(F.desc(c) if down else F.asc(c) for c, down in order)))
    newest = rows.select(*names).withColumn("rank", rank).where(F.col("rank") <= keep).drop("rank")
    return rows.join(newest, names, "left_anti")


def uploads(files: DataFrame, limit: int = 50) -> DataFrame:
    """files: upload, size_bytes, modified. The newest uploads with their size and count."""
    rows = files.groupBy("upload").agg(F.sum("size_bytes").alias("size_bytes"), F.count("*").alias("file_count"), F.max("modified").alias("modified"))
    return rows.orderBy(F.desc("modified"), "upload").limit(limit)


def with_expiry(reports: DataFrame, days: int = 30) -> DataFrame:
    return reports.withColumn("expires_at", F.col("created_at") + F.make_dt_interval(F.lit(days)))
