"""Exact deduplication against a persistent digest index, bucketed and sorted by the digest.

New rows are reduced to one winner for each digest, compared with the index by a sort-merge anti-join that reads
the index without a shuffle, and the winners that are new are appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.session import shared_folder, written

WHITE = r"[\x20\x09-\x0D]+"


def digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text without its white space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, ""), 256))


class DigestIndex:
    """A table (digest, keep_id, n_points, batch) in ``buckets`` buckets, sorted by digest within each file."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int = 32):
        self.spark, self.name, self.buckets = spark, name, buckets
        self.path = path or f"{shared_folder(spark)}/{name}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, n_points INT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    @classmethod
    def fresh(cls, spark: SparkSession, **kw) -> DigestIndex:
        return cls(spark, f"digest_index_{uuid.uuid4().hex}", **kw)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
        """Deduplicate ``docs`` against themselves and the index, and append what is new.

        Returns (counts, groups). counts: (digest, doc_id, n_points, copies), a row for each distinct one in ``docs``.
        groups: (digest, keep_id, n_points, group_size, fresh), a row for each digest in ``docs``: who stays (the row
        with most code points, then the smallest id, null ids last; for a digest the index knew, the index's row),
        how many rows of ``docs`` share the digest, and whether it is new. Every column may be null and the table empty.
        """
        counts = written(
            docs.select(
                digest(F.col(text_col)).alias("digest"), F.col(id_col).cast("long").alias("doc_id"),
                F.coalesce(F.length(text_col), F.lit(0)).alias("n_points"),
            ).groupBy("digest", "doc_id", "n_points").agg(F.count("*").alias("copies"))
        )
        best = F.struct("n_points", (-F.col("doc_id")).alias("low_id"))
        batch = counts.groupBy("digest").agg(
            F.max(best).alias("best"), F.sum("copies").alias("group_size")
        ).select("digest", (-F.col("best.low_id")).alias("keep_id"), F.col("best.n_points").alias("n_points"), "group_size")
        known = self.spark.table(self.name)
        fresh = batch.hint("merge").join(known.hint("merge"), "digest", "left_anti").withColumn("fresh", F.lit(True))
        seen = batch.drop("keep_id", "n_points").join(known.drop("batch"), "digest").withColumn("fresh", F.lit(False))
        groups = written(fresh.unionByName(seen))
        new = groups.filter("fresh").select("digest", "keep_id", "n_points", F.lit(uuid.uuid4().hex).alias("batch"))
        (
            new.repartition(self.buckets, "digest").write.mode("append").format("parquet").option("path", self.path)
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )
        return counts, groups


def decisions(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each row that was added: doc_id, keep_id, group_size, kept, digest.

    Of rows equal in digest, id and length only the first is kept. The join is a plain one on the digest, so a
    digest that holds a third of all rows can be split.
    """
    stays = F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("best_points"))
    return (
        counts.join(groups.withColumnRenamed("n_points", "best_points"), "digest")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("doc_id", "keep_id", "group_size", (stays & (F.col("copy") == 1)).alias("kept"), "digest")
    )


def keep_first(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that ``index.add`` keeps. Rows equal in id, length and digest keep one of them.

    A row travels packed in one column, so no column of ``docs`` can clash with those used here.
    """
    counts, groups = index.add(docs, id_col, text_col)
    same_row = (F.col("c.digest") == F.col("g.digest")) & F.col("c.doc_id").eqNullSafe(F.col("g.keep_id")) & (F.col("c.n_points") == F.col("g.n_points"))
    won = written(counts.alias("c").join(groups.filter("fresh").alias("g"), same_row).select("c.digest", "c.doc_id", "c.n_points", "c.copies"))
    here = docs.select(
        digest(F.col(text_col)).alias("digest"), F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.length(text_col), F.lit(0)).alias("n_points"), F.struct("*").alias("row"),
    )
    on = (F.col("h.digest") == F.col("w.digest")) & F.col("h.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("h.n_points") == F.col("w.n_points"))
    rows = here.alias("h").join(won.alias("w"), on).select("h.*", "w.copies")
    if won.filter("copies > 1").isEmpty():
        return rows.select("row.*")
    single = rows.filter("copies = 1").select("row.*")
    return single.unionByName(rows.filter("copies > 1").dropDuplicates(["doc_id", "digest"]).select("row.*"))
