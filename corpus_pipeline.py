"""A training corpus from ``documents``: language ID, exact and near deduplication, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes and rereads the
table between stages. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import decontaminate, exact_dedup, langid, mixing, ngram_jaccard
from frameloom.session import ship_package, written

#: A document is rejected if it has no letters or if no language reaches this mean probability.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: not ``und``, and with a score of at least ``LEAST_SCORE``.

    The model learns from a bounded, hashed sample of the stage's own labelled rows. Without labels nothing can be
    judged and all documents with letters stay.
    """
    ship_package(spark)
    model = langid.fit(docs)
    if model is None:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    judged = langid.identify(docs.select("text", F.struct("*").alias("row")), model)
    return judged.filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of texts equal but for white space."""
    return exact_dedup.keep_first(docs, exact_dedup.DigestIndex.fresh(spark))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links at 0.8 over five-word shingles."""
    ship_package(spark)
    return ngram_jaccard.keep_one(docs, n_words=5, percent=80)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``, edits allowed."""
    ship_package(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with size, source_size, target and taken."""
    return mixing.mix(docs, carry=True).filter("taken > 0")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard", near_duplicates),
    ("decontaminate", benchmark_items),
    ("mixing", mixture),
]

#: Language ID and edit matching are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
