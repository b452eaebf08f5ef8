"""Sources and sinks: directories, ZIP archives and reports."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..shipping import ship
from .archives import members

SCHEMA = "repo_id string, path string, size_bytes long, modified timestamp, content string"


def read_directory(spark: SparkSession, root: str, repo_id: str, pruned: bool = True, text: bool = True) -> DataFrame:
    """Files below a folder: repo_id, path (relative), size_bytes, modified, content (null unless text)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file:")
    rel = F.regexp_replace("path", "^.*?" + "".join("\\" + c if c in r"\.+*?()[]{}^$|" else c for c in base) + "/", "")
    content = F.make_valid_utf8(F.col("content").cast("string")) if text else F.lit(None).cast("string")
    rows = rows.select(F.lit(repo_id).alias("repo_id"), rel.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), content.alias("content"))
    return rows.where(paths.scan_kept(F.col("path"))) if pruned else rows


def read_archives(spark: SparkSession, pattern: str, max_mb: int = 100) -> DataFrame:
    """Members of ZIP archives, one row each: repo_id (archive name), path, size_bytes, content, error (see archives.members).

    Spark's own reader fetches each archive whole, from any store; a task holds one archive and one inflated
    member at a time. archives.read_archives_in_ranges shares an archive out to several tasks.
    """
    ship(spark)
    archives = spark.read.format("binaryFile").load(pattern)
    archives = archives.select(F.regexp_replace(paths.basename(F.col("path")), r"\.zip$", "").alias("repo_id"), "length", "content")
    schema = pa.schema([("repo_id", pa.string()), ("path", pa.string()), ("size_bytes", pa.int64()), ("content", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in zip(*(b.column(c).to_pylist() for c in ("repo_id", "length", "content")), strict=True):
                for row in members(io.BytesIO(archive[2]), archive[0], archive[1], max_mb << 20):  # one member in memory at a time
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    return archives.mapInArrow(run, "repo_id string, path string, size_bytes long, content string, error string")


def write_reports(reports: DataFrame, folder: str, exported_at: str) -> None:
    """Reports as JSON lines with an _export block. exported_at is given, so reruns write the same."""
    meta = F.struct(F.lit("json").alias("format"), F.lit(exported_at).alias("exported_at"), F.col("analysis_id").alias("report_id"), F.lit("1.0").alias("version"))
    reports.withColumn("_export", meta).write.mode("overwrite").json(folder)


def read_reports(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(folder)
