"""Embeddings by digest, cosine similarity and exact top-k by one query vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _with(value: Column, then) -> Column:
    """then(value), where the value is computed once however often it is used, in lambdas too."""
    return F.element_at(F.transform(F.array(value), then), 1)


def digest_components(text: Column) -> Column:
    """32 numbers from -1 to 1: the bytes of the text's SHA-256."""
    byte = lambda digest: lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int") / 255.0 * 2 - 1
    return _with(F.sha2(text, 256), lambda digest: F.transform(F.sequence(F.lit(0), F.lit(31)), byte(digest)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    over = lambda v, norm: F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))
    return _with(v, lambda v: _with(F.sqrt(dot(v, v)), lambda norm: over(v, norm)))


def embed(text: Column) -> Column:
    """The digest embedding of a text, line feeds as spaces and trimmed; null for a blank one."""
    clean = F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.when(clean != "", normalised(digest_components(clean)))


def code_text(code: Column, language: Column) -> Column:
    """What is embedded for a piece of code."""
    return F.concat(F.lit("["), language, F.lit(" code]\n"), code)


def embed_once(items: DataFrame, text: str = "text") -> DataFrame:
    """items with embedding; every distinct text is embedded once and joined back by its MD5."""
    key = F.md5(F.col(text))
    distinct = items.select(key.alias("_key"), F.col(text).alias("_text")).dropDuplicates(["_key"])
    distinct = distinct.select("_key", embed(F.col("_text")).alias("embedding"))
    return items.withColumn("_key", key).join(distinct, "_key", "left").drop("_key")


def seeded_embedding(text: Column) -> Column:
    """256 normal numbers seeded by the text's MD5, for tests that need vectors without a model."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    def one(t: str | None):
        return None if t is None else np.random.default_rng(int(hashlib.md5(t.encode()).hexdigest(), 16)).standard_normal(256)

    def each(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    each.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, "array<double>")(text)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of unlike length or without length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def top_k(items: DataFrame, query: Column, k: int = 5, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """The k items most like one query vector; items without a vector are skipped."""
    rows = items.where(F.col(vector).isNotNull()).select(id_col, cosine(F.col(vector), query).alias("similarity"))
    return rows.orderBy(F.desc("similarity"), id_col).limit(k)


def distinct_texts(items: DataFrame, text: str = "text") -> DataFrame:
    """One row per text to embed, by its MD5, so that copies are embedded once and joined back."""
    return items.groupBy(F.md5(F.col(text)).alias("key")).agg(F.count("*").alias("copies"))
