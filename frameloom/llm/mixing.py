"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Each document goes to a shard by hash, so that a hot source spreads over many shards and a tiny one keeps to one.
In every shard, equal-token blocks are dealt to the sources there by highest quotients ``w / (2k + 1)``, which
gives each source an integer quota. The documents of a source in a shard lie one after the other in a seeded
order; the quota takes whole passes over them, then blocks from the start of that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.session import written

WORD = r"[^\x20\x09-\x0D]+"


def _md5_int(*parts: Column | str) -> Column:
    """32 bits of an md5, the same in any SQL engine."""
    text = F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``sizes`` (skey, source, source_size) with a weight by rank and a water-filled target.

    Sources with the least ``cap * size / weight`` reach their cap first. With ``k`` of them capped the level of
    the others is ``(share * total - caps) / (weights left)``; the right level is the largest that its own source
    can hold. The window holds a row for each source, so it grows with their number alone.
    """
    everything = Window.partitionBy()
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", "source_no")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    cycle = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return (
        sizes.withColumn("source_no", F.row_number().over(rank))
        .withColumn("weight", cycle)
        .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
        .withColumn("target", F.least("most", F.col("weight") * F.coalesce("level", F.lit(float("inf")))))
        .select("skey", "source_no", "source_size", "target")
    )


def quotas(held: DataFrame, block_tokens: int) -> DataFrame:
    """Integer block quotas by highest quotients: ``held`` (shard, skey, source_no, tokens, wish) plus ``quota``.

    With ``n`` sources and ``q`` seats the divisor lies between ``wish / (q + n/2)`` and ``wish / (q - n/2)`` of the
    shard, so only quotients in that band can be in doubt; the seats below it are certain.
    """
    shard = Window.partitionBy("shard")
    best = Window.partitionBy("shard").orderBy(F.col("quotient").desc(), "source_no", "k")
    slack = F.col("n") / (2 * F.col("seats"))
    band = (
        held.withColumn("all", F.sum("wish").over(shard))
        .withColumn("n", F.count("*").over(shard))
        .withColumn("seats", F.floor(F.col("all") / block_tokens + 0.5))
        .filter((F.col("seats") > 0) & (F.col("wish") > 0))
        .withColumn("fair", F.col("seats") * F.col("wish") / F.col("all"))
        .withColumn("sure", F.greatest(F.lit(0).cast("long"), F.floor(F.col("fair") * (1 - slack) - 0.5)))
        .withColumn("free", F.col("seats") - F.sum("sure").over(shard))
        .withColumn("k", F.explode(F.sequence("sure", F.ceil(F.col("fair") * (1 + slack) + 0.5))))
        .withColumn("quotient", F.col("wish") / (2 * F.col("k") + 1))
        .withColumn("place", F.row_number().over(best))
    )
    won = band.groupBy("shard", "skey").agg((F.max("sure") + F.count_if(F.col("place") <= F.col("free"))).alias("quota"))
    return held.join(won, ["shard", "skey"], "left").withColumn("quota", F.coalesce("quota", F.lit(0).cast("long")))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    block_tokens: int = 16,
    shard_tokens: int = 1 << 18,
    seed: str = "mix-1",
    carry: bool = False,
) -> DataFrame:
    """Words that a weighted mix of the sources takes from each document.

    Returns a row for each row of ``docs``: id, size, source_size, target, taken; with ``carry`` all columns of
    ``docs`` and these four (a column of such a name in ``docs`` is replaced). Null or empty text has size 0 and
    takes 0; a null source is a source of its own, last in order. Equal rows take what their places in the seeded
    order give, as one set the same in every run. An empty table gives no rows. ``taken`` is at most ``cap`` times
    the size; a block may end inside a document.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    skey = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col)))
    columns = [f"`{c}`" for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken")] if carry else [id_col]
    rows = docs.select(
        F.struct(*columns).alias("row"), size.alias("size"), skey.alias("skey"), F.col(source_col).alias("source"),
        _md5_int(seed, F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("deal"),
    )
    if not carry:
        rows = written(rows)  # whole texts are read once; what is left is a few numbers for each document
    sizes = rows.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, share, cap).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    goal = written(goal)
    parts = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens))
    shards = F.greatest(F.lit(1), F.ceil(F.col("total") / shard_tokens))
    dealt = rows.drop("source").join(goal, "skey").withColumn("shard", (_md5_int(seed, F.col("skey")) + F.col("deal") % parts) % shards)
    held = (
        dealt.groupBy("shard", "skey", "source_no")
        .agg(F.sum("size").alias("tokens"), F.max("target").alias("target"), F.max("source_size").alias("source_size"))
        .withColumn("wish", F.when(F.col("source_size") > 0, F.col("target") * F.col("tokens") / F.col("source_size")).otherwise(0.0))
        .drop("target", "source_size")
    )
    won = written(quotas(held, block_tokens).select("shard", "skey", "tokens", "quota"))
    order = Window.partitionBy("shard", "skey").orderBy("deal", f"row.{id_col}", "size").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.least(F.col("quota") * block_tokens, F.floor(F.lit(cap) * F.col("tokens")))
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("wanted") / F.col("tokens"))).otherwise(0)
    start = F.col("end") - F.col("size")
    rest = F.col("wanted") - F.col("passes") * F.col("tokens")
    again = F.greatest(F.lit(0), F.least("end", rest) - start)
    return (
        dealt.withColumn("end", F.sum("size").over(order))
        .join(won, ["shard", "skey"])
        .withColumn("wanted", wanted)
        .withColumn("passes", passes)
        .select("row.*", "size", "source_size", "target", (F.col("passes") * F.col("size") + again).cast("long").alias("taken"))
    )
