"""Stored reports as semi-structured values: candidates, summaries with defaults, schemas and JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths

#: Where a report may lie below the storage folder, best first: pattern and the expression that finds its id.
PLACES = (
    ("reports/*.json", r"reports/([^/]*)\.json$"), ("reports/*", r"reports/([^/]*)$"), ("uploads/*/analysis.json", r"uploads/([^/]*)/analysis\.json$"),
    ("repos/*/analysis.json", r"repos/([^/]*)/analysis\.json$"),
)

#: The summary's fields: name, path in the report, type, default (SQL).
SUMMARY = (
    ("analysis_id", "$.analysis_id", "string", "report_id"), ("path", "$.path", "string", "'Unknown'"),
    ("timestamp", "$.timestamp", "string", "date_format(created, \"yyyy-MM-dd'T'HH:mm:ss\")"), ("status", "$.status", "string", "'completed'"),
    ("files_analyzed", "$.files_analyzed", "bigint", "0"), ("total_lines", "$.total_lines", "bigint", "0"), ("total_size_bytes", "$.total_size_bytes", "bigint", "0"),
    ("risk_level", "$.metrics.risk", "string", "'unknown'"), ("risk_score", "$.metrics.risk_score", "double", "0"),
    ("risk_factors", "$.metrics.risk_factors", "array<string>", "cast(array() AS array<string>)"),
    ("secrets_found", "$.security.secrets_found", "bigint", "0"), ("vulnerabilities_found", "$.security.vulnerabilities_found", "bigint", "0"),
    ("critical_issues", "$.security.critical_issues", "bigint", "0"), ("avg_complexity", "$.complexity.average_complexity", "double", "0"),
    ("high_complexity_files", "$.complexity.high_complexity_files", "bigint", "0"), ("total_dependencies", "$.dependencies.total", "bigint", "0"),
    ("vulnerable_dependencies", "$.dependencies.vulnerable", "bigint", "0"), ("outdated_dependencies", "$.dependencies.outdated", "bigint", "0"),
    ("file_types", "$.file_types", "map<string,bigint>", "cast(map() AS map<string,bigint>)"),
)


def read_candidates(spark: SparkSession, storage: str) -> DataFrame:
    """report_id, priority, content, created and modified of every file at one of PLACES; places without a file are left out."""
    found = None
    for k, (pattern, name) in enumerate(PLACES):
        try:
            rows = spark.read.format("binaryFile").load(f"{storage.rstrip('/')}/{pattern}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        rows = rows.where(~F.col("path").endswith(".json")) if k == 1 else rows
        rows = rows.select(
            F.regexp_extract("path", name, 1).alias("report_id"), F.lit(k).alias("priority"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
            F.col("modificationTime").alias("created"), F.col("modificationTime").alias("modified"),
        )
        found = rows if found is None else found.union(rows)
    return spark.createDataFrame([], "report_id string, priority int, content string, created timestamp, modified timestamp") if found is None else found


def problem(content: Column) -> Column:
    """Why a text is no report, or null: it isn't JSON, no object, or has neither a path nor an analysis_id."""
    v = F.try_parse_json(content)
    has = F.variant_get(v, "$.path", "variant").isNotNull() | F.variant_get(v, "$.analysis_id", "variant").isNotNull()
    return F.when(v.isNull(), "not json").when(~F.schema_of_variant(v).startswith("OBJECT"), "no object").when(~has, "no report")


def reports(candidates: DataFrame) -> DataFrame:
    """One row for each report that has a valid candidate: the best of them, with its content parsed as `data`.

    Candidates are told apart by priority, the least first; each is parsed where it is read, and
    only the best of each report in a task is shuffled.
    """
    good = candidates.where(problem(F.col("content")).isNull())
    columns = [c for c in candidates.columns if c != "report_id"]
    best = good.groupBy("report_id").agg(F.min_by(F.struct(*columns), F.struct("priority", "content")).alias("b"))
    return best.select("report_id", "b.*").withColumn("data", F.parse_json("content"))


def set_aside(candidates: DataFrame) -> DataFrame:
    """report_id, priority and problem of the candidates that are no reports."""
    return candidates.select("report_id", "priority", problem(F.col("content")).alias("problem")).where(F.col("problem").isNotNull())


def summaries(rows: DataFrame) -> DataFrame:
    """The flat summary of each report: id, SUMMARY's fields, size and times.

    What a report lacks, has as null or in a type that doesn't convert takes its default; numbers
    in texts are read as numbers. rows: see reports.
    """
    fields = [F.coalesce(F.try_variant_get("data", at, kind), F.expr(default).cast(kind)).alias(name) for name, at, kind, default in SUMMARY]
    size = F.octet_length("content").cast("long")
    return rows.select(F.col("report_id").alias("id"), *fields, size.alias("size_bytes"), paths.human_size(size).alias("size_human"), "created", "modified")


def listing(rows: DataFrame, limit: int = 50) -> DataFrame:
    """id, filename, size_kb, modified, path and analysis_id of the reports changed last."""
    get = lambda at, default: F.coalesce(F.try_variant_get("data", at, "string"), default)
    return rows.orderBy(F.desc("modified"), "report_id").limit(limit).select(
        F.col("report_id").alias("id"), F.concat("report_id", F.lit(".json")).alias("filename"), (F.octet_length("content") / 1024).alias("size_kb"), "modified",
        get("$.path", F.lit("Unknown")).alias("path"), get("$.analysis_id", F.col("report_id")).alias("analysis_id"),
    )


def merged_schema(rows: DataFrame) -> DataFrame:
    """One row: the schema that all reports together have."""
    return rows.agg(F.schema_of_variant_agg("data").alias("schema"))


def jsonable(c: Column, kind: T.DataType) -> Column:
    """The value with everything in it that JSON has no form for as text, at any depth.

    Dates and times in ISO form, decimals in their digits, binaries in base64, other types as they
    print; keys of maps become text. to_json itself writes numbers that are not finite as text.
    """
    if isinstance(kind, T.StructType):
        fields = [jsonable(c[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields)) if fields else c.cast("string")
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: jsonable(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("key"), jsonable(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(entries)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        micro = F.date_format(c, "SSSSSS")
        return F.when(micro == "000000", whole).otherwise(F.concat(whole, F.lit("."), micro))
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    if isinstance(kind, (T.StringType, T.BooleanType, T.FloatType, T.DoubleType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.VariantType, T.NullType)):
        return c
    return c.cast("string")


def export_json(rows: DataFrame, exported_at: str, key: str = "analysis_id") -> DataFrame:
    """key and json: each row as one JSON text with an _export block; columns of any type."""
    fields = [jsonable(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields]
    block = F.struct(F.lit("json").alias("format"), F.lit(exported_at).alias("exported_at"), F.col(key).cast("string").alias("report_id"), F.lit("1.0").alias("version"))
    return rows.select(key, F.to_json(F.struct(*fields, block.alias("_export")), {"ignoreNullFields": "false"}).alias("json"))
