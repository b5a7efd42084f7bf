"""The thin queries ``opN_<name>``: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from frameloom.llm import decontaminate, exact_dedup, html_text, langid, lm_scoring, mixing, ngram_jaccard, pii, secret_scan, url_filter
from frameloom.session import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex.fresh(spark)
    out = exact_dedup.decisions(*index.add(_table(spark, sf_dir, "documents")))
    return out.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def _remainder(n: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_jaccard.near_classes(_table(spark, sf_dir, "documents"), n_words=4, percent=85)
    return out.select("doc_id", "n_shingles", "component_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (_remainder(4) == 2).alias("held_out"))
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.identify(docs.drop("lang"), model).drop("text")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (_remainder(5) != 1).alias("train"))
    out = lm_scoring.score(docs)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_exact_dedup, op3_ngram_jaccard, op4_language_id, op5_html_text, op6_decontaminate,
        op7_lm_scoring, op8_url_filter, op9_pii, op10_secret_scan, pipeline,
    )
}
