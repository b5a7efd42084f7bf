"""Symbols of the entropy stage: DC differences, categories, AC runs, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.operators.transform import FRAME


def category(v: Column) -> Column:
    """Bits of the magnitude."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v.cast("long"))))).cast("int")


def magnitude_code(v: Column) -> Column:
    """Bits written for a value: itself, or a negative one plus 2 ** category - 1."""
    return F.when(v >= 0, v).otherwise(v + F.pow(F.lit(2), category(v)).cast("long") - 1).cast("int")


def dc_differences(dc: DataFrame, plane: tuple[str, ...] = FRAME) -> DataFrame:
    """DC values less the block's before, from 0 in each plane."""
    before = F.lag("dc", 1, 0).over(Window.partitionBy(*plane).orderBy("block_no"))
    return dc.withColumn("diff", F.col("dc") - before).withColumns({"category": category(F.col("diff")), "code": magnitude_code(F.col("diff"))})


def ac_symbols(rows: DataFrame) -> DataFrame:
    """AC symbols (…, zz, symbol, n) of blocks with ``c`` in zig-zag order: run and size of each value, 0xF0 for 16
    zeros, 0x00 for zeros to the end. Each block gives its own symbols; nothing is shuffled."""
    keys = [c for c in rows.columns if c != "c"]
    places = F.filter(F.transform("c", lambda c, zz: F.when((zz > 0) & (c != 0), zz)), lambda z: z.isNotNull())
    live = rows.withColumn("_places", places)
    before = F.concat(F.array(F.lit(0)), F.col("_places"))
    runs = F.transform("_places", lambda z, i: F.struct(z.alias("zz"), (z - F.get(before, i) - 1).alias("run"), category(F.get(F.col("c"), z)).alias("size")))

    def entry(zz, symbol, n):
        return F.struct(zz.cast("int").alias("zz"), symbol.cast("int").alias("symbol"), n.cast("long").alias("n"))

    coded = F.transform("_runs", lambda r: entry(r["zz"], F.when(r["size"] == 16, 256 + r["run"] % 16).otherwise(r["run"] % 16 * 16 + r["size"]), F.lit(1)))
    long = F.transform(F.filter("_runs", lambda r: r["run"] >= 16), lambda r: entry(r["zz"], F.lit(0xF0), F.floor(r["run"] / 16)))
    open_ = F.coalesce(F.get(F.col("c"), F.lit(63)), F.lit(0)) == 0
    end = F.when(open_, F.array(entry(F.lit(64), F.lit(0), F.lit(1)))).otherwise(F.array().cast("array<struct<zz:int,symbol:int,n:bigint>>"))
    out = live.withColumn("_runs", runs).select(*keys, F.explode(F.concat(coded, long, end)).alias("e"))
    return out.select(*keys, "e.zz", "e.symbol", "e.n")


def histogram(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("symbol").agg(F.sum("n").cast("long").alias("count"))
