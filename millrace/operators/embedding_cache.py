"""Embeddings kept in a table, so that no text is embedded twice in any run."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors

SCHEMA = "key string, embedding array<double>, lines long, run string, kind string, language string, part string"


def text_embedding(text: Column) -> Column:
    return vectors.embed(text)


def code_embedding(code: Column, language: Column) -> Column:
    return vectors.embed(vectors.code_text(code, language))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """What the cache holds; each key once, of the run that came first by name."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)
    first = F.min_by(F.struct("embedding", "lines", "run"), "run").alias("v")
    return rows.groupBy("kind", "language", "part", "key").agg(first).select("kind", "language", "part", "key", "v.*")


def _keyed(items: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The parts of a text's key: its kind, its language ('none' without one), its MD5 and that one's first digit, by which the table is cut."""
    key = F.md5(F.coalesce("text", F.lit("")))
    return items.select(
        *(columns or []), F.col("kind"), F.coalesce(F.nullif("language", F.lit("")), F.lit("none")).alias("language"), F.substring(key, 1, 1).alias("part"), key.alias("key"), F.coalesce("text", F.lit("")).alias("text")
    )


def fill(items: DataFrame, folder: str, run: str) -> None:
    """Embeds the texts that the cache lacks and adds them to it.

    items: kind ('text' or 'code'), language, text. Distinct keys meet the cache in an anti-join of
    short rows; only missing texts are embedded and written, a file or so for each part. The
    rows of a run show up when its write commits. Two runs at once may write a key twice, with the same
    vector; readers take one. Blank texts are kept with a null vector, so they aren't tried again.
    """
    rows = _keyed(items)
    names = ["kind", "language", "part", "key"]
    missing = rows.dropDuplicates(names).join(read(items.sparkSession, folder).select(*names), names, "left_anti")
    vector = F.when(F.col("kind") == "code", code_embedding(F.col("text"), F.col("language"))).otherwise(text_embedding(F.col("text")))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    made = missing.select("key", vector.alias("embedding"), lines.cast("long").alias("lines"), F.lit(run).alias("run"), "kind", "language", "part")
    made.repartition("kind", "language", "part").write.mode("append").partitionBy("kind", "language", "part").parquet(folder)


def embedded(items: DataFrame, folder: str) -> DataFrame:
    """items with embedding, lines and the run that made the vector; nulls where the cache has none. items: see fill, with other columns."""
    others = [c for c in items.columns if c not in ("kind", "language", "text")]
    rows = _keyed(items, others)
    return rows.join(read(items.sparkSession, folder), ["kind", "language", "part", "key"], "left").drop("part")


def similar_code(items: DataFrame, code: str, language: str = "python", k: int = 5) -> DataFrame:
    """The k items most like a piece of code. items: id, embedding."""
    query = code_embedding(F.lit(code), F.lit(language))
    return vectors.top_k(items, query, k)
