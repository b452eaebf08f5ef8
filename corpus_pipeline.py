"""The corpus pipeline: five stages over documents, each writing what the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import mixing, simhash, substrings, toxicity
from millrace.llm.common import materialize, table
from millrace.llm.packing import pack

#: No SQL expresses the stages; tests/llm/test_pages_vectors_pipeline.py holds the near-duplicate, repeats and mixing stages
#: against brute force and the others' effects on what they were given.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go.

    A null or empty text scores like any other and stays below the threshold; rows of one or no
    doc_id are each scored by their own text; an empty table stays empty; columns are kept.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; links of a group: five-word shingles, Jaccard 0.8 or more.

    See simhash.one_of_each: unlike texts under one or no doc_id all stay; null, empty and blank
    texts are one group; of repeated rows one stays; an empty table stays empty; columns are kept,
    whatever their names, and long texts are compared whole.
    """
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut out.

    Earlier: of a smaller doc_id, so rows of one doc_id cut nothing from each other, and a row
    without one comes after all others. A null text stays null; texts are read whole; an empty
    table stays empty; other columns are kept.
    """
    return substrings.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's target asks for, each at its own time of the run.

    A copy that the target cuts stays if at least half of it is wanted. A text without words takes
    no place in the mix and stays once; rows without a source are one source; repeated rows count
    each; an empty table stays empty; columns are kept, whatever their names.
    """
    mixed = mixing.mix(docs, carry=tuple(docs.columns))
    copies = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    rows = mixed.where((copies > 0) | (F.col("size") == 0))
    rows = rows.select("*", F.posexplode_outer(F.slice("positions", F.lit(1), copies)).alias("copy", "at"))
    rows = rows.orderBy(F.col("at").asc_nulls_last(), "doc_id", "copy")
    return rows.select(*(F.col(f"carried_{k}").alias(c) for k, c in enumerate(docs.columns)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all copies and their places in sequences of 1024.

    A null or empty text is one piece, its end token; long texts are cut into pieces; copies of a
    doc_id, or of none, are packed each; an empty table gives no piece.
    """
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("repeated_passages", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
