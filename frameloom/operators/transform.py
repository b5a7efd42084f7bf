"""The 8 x 8 cosine transform and its coefficient edits.

A block is one row: its key columns, and 64 values in an array. The transform, the quantizer and the edits are
arithmetic on that array, so a plane is shuffled once, when its samples become blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions import u64
from frameloom.functions.scalars import clamp, every, half_away, jpeg_table, rotated, short
from frameloom.functions.tables import LUMA, ZIGZAG, cosine

FRAME = ("stream_id", "frame_no")


def blocks(plane: DataFrame, width: int, height: int, value: str, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """A plane (keys, y, x, value) as rows (keys, block_no, s): 64 samples around 0, row by row.

    Blocks stand in raster order. Where the plane is no multiple of 8, its last column and row are repeated.
    """
    across, down = -(-width // 8), -(-height // 8)
    reach = lambda c, n, m: F.explode(F.sequence(F.col(c), F.when(F.col(c) == n - 1, m - 1).otherwise(F.col(c))))
    spread = plane.select(*keys, "x", (F.col(value) - 128).cast("int").alias("s"), reach("y", height, 8 * down).alias("py"))
    spread = spread.select(*keys, "py", "s", reach("x", width, 8 * across).alias("px"))
    block = (F.floor(F.col("py") / 8) * across + F.floor(F.col("px") / 8)).cast("int")
    sample = F.struct((F.col("py") % 8 * 8 + F.col("px") % 8).alias("pos"), "s")
    rows = spread.groupBy(*keys, block.alias("block_no")).agg(F.array_sort(F.collect_list(sample)).alias("p"))
    return rows.select(*keys, "block_no", F.transform("p", lambda p: p["s"]).alias("s"))


def _cosines(turned: bool) -> Column:
    """8 arrays of 8 values: the basis u at each x, or at x each basis if ``turned``."""
    return F.array(*(F.array(*(F.lit(cosine(m, n) if turned else cosine(n, m)) for m in range(8))) for n in range(8)))


def _rows_then_columns(values: str, turned: bool) -> Column:
    """The separable product of an 8 x 8 array with the basis on both sides.

    Spark puts the expression of a column where its name stands, so ``values`` is named once and outside of all loops.
    The first product is made by columns, which makes them the rows of the second.
    """
    table = _cosines(turned)

    def product(rows):
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda total, pq: total + pq)
        return F.transform(table, lambda a: F.transform(rows, lambda b: dot(a, b)))

    rows = u64.let(F.col(values).cast("array<double>"), lambda v: F.transform(F.sequence(F.lit(1), F.lit(57), F.lit(8)), lambda n: F.slice(v, n, F.lit(8))))
    return F.flatten(u64.let(u64.let(rows, product), product))


def forward(rows: DataFrame) -> DataFrame:
    """Samples ``s`` to coefficients ``f`` (double), at 8 v + u."""
    return rows.withColumn("f", _rows_then_columns("s", False)).drop("s")


def inverse(rows: DataFrame) -> DataFrame:
    """Coefficients ``f`` to samples ``s`` (double)."""
    return rows.withColumn("s", _rows_then_columns("f", True)).drop("f")


def quantized(rows: DataFrame, quality: int = 50) -> DataFrame:
    """Samples ``s`` to integer coefficients ``c`` in zig-zag order. The transform is rounded to 6 places first, so that
    sums in another order can't change what lies at a half."""
    table = jpeg_table(LUMA, quality)
    order = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(float(table[n])).alias("q")) for n in ZIGZAG))
    return forward(rows).withColumn("c", F.transform(order, lambda z: short(half_away(F.round(F.round(F.get(F.col("f"), z["n"]), 6) / z["q"], 6))))).drop("f")


def listed(rows: DataFrame, quality: int = 50) -> DataFrame:
    """Blocks with ``c`` as a row (…, u, v, zz, q, c) for each coefficient."""
    table = jpeg_table(LUMA, quality)
    at = F.array(*(F.struct(F.lit(n % 8).alias("u"), F.lit(n // 8).alias("v"), F.lit(table[n]).alias("q")) for n in ZIGZAG))
    keys = [c for c in rows.columns if c != "c"]
    out = rows.select(*keys, F.posexplode(F.arrays_zip(F.col("c"), at.alias("at"))).alias("zz", "e"))
    return out.select(*keys, "e.at.u", "e.at.v", "zz", "e.at.q", "e.c")


def _ac(rows: DataFrame, change) -> DataFrame:
    """The 63 AC values changed together; the DC value stays."""
    return rows.withColumn("c", F.concat(F.slice("c", 1, 1), change(F.slice("c", 2, 63))))


def ac_rotated(rows: DataFrame, by: int) -> DataFrame:
    """The 63 AC values rotated left by ``by`` along the zig-zag."""
    return _ac(rows, lambda ac: rotated(ac, -by))


def zigzag_reversed(rows: DataFrame) -> DataFrame:
    """AC values mirrored along the zig-zag."""
    return _ac(rows, F.reverse)


def transposed(rows: DataFrame) -> DataFrame:
    place = {n: z for z, n in enumerate(ZIGZAG)}
    source = F.array(*(F.lit(place[n % 8 * 8 + n // 8]) for n in ZIGZAG))
    return rows.withColumn("c", F.transform(source, lambda z: F.get(F.col("c"), z)))


def low_passed(rows: DataFrame, cutoff: int) -> DataFrame:
    return rows.withColumn("c", F.transform("c", lambda c, zz: F.when(zz > cutoff, 0).otherwise(c)))


def requantized(rows: DataFrame, scale: float) -> DataFrame:
    """Rounded to multiples of ``scale``, truncated to an integer."""

    def one(c):
        v = clamp(half_away(c / F.lit(float(scale))) * F.lit(float(scale)), -32768.0, 32767.0)
        return (F.signum(v) * F.floor(F.abs(v))).cast("int")

    return rows.withColumn("c", F.transform("c", one))


def sign_flipped(rows: DataFrame, n: int, ordinal: Column) -> DataFrame:
    """AC values of each n-th block negated, saturating."""
    return rows.withColumn("c", F.when(every(n, ordinal), F.transform("c", lambda c, zz: F.when(zz > 0, short(-c)).otherwise(c))).otherwise(F.col("c")))


def dc_offset(rows: DataFrame, n: int, ordinal: Column, by: int) -> DataFrame:
    return rows.withColumn("c", F.when(every(n, ordinal), F.transform("c", lambda c, zz: F.when(zz == 0, short(c + by)).otherwise(c))).otherwise(F.col("c")))


def dc_values(rows: DataFrame) -> DataFrame:
    """The first coefficient (…, dc) of each block."""
    return rows.withColumn("dc", F.get("c", F.lit(0))).drop("c")


def dc_drift(dc: DataFrame, n: int, step: int, channel: int = 0, plane: tuple[str, ...] = FRAME) -> DataFrame:
    """DC values (plane, block_no, dc) with a running offset: each n-th block adds or takes ``step`` by a hashed sign."""
    i = F.col("block_no") + 1
    trigger = F.floor(i / n)
    bit = F.shiftrightunsigned(u64.splitmix(trigger), channel).bitwiseAND(F.lit(1))
    change = F.when(every(n, i), F.when(bit == 0, step).otherwise(-step)).otherwise(0)
    total = F.sum(change).over(Window.partitionBy(*plane).orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0))
    return dc.withColumn("drift", total.cast("int")).withColumn("dc", short(F.col("dc") + F.col("drift")))


def block_sources(rows: DataFrame, columns: int, height: int, shift_n: int, shift: tuple[int, int], repeat_n: int) -> DataFrame:
    """For each block (block_no) the block it reads: shifted at each n-th, else the one before at each m-th."""
    i = F.col("block_no")
    x, y = i % columns, F.floor(i / columns)
    moved = F.pmod(y + shift[1], F.lit(height)) * columns + F.pmod(x + shift[0], F.lit(columns))
    return rows.withColumn("source_no", F.when(every(shift_n, i + 1), moved).when(every(repeat_n, i + 1) & (i > 0), i - 1).otherwise(i).cast("int"))


def chroma_mean(pixels: DataFrame, value: str, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """Means of 2 x 2 cells; cells cut by an edge have fewer samples."""
    return pixels.groupBy(*keys, F.floor(F.col("y") / 2).cast("int").alias("cy"), F.floor(F.col("x") / 2).cast("int").alias("cx")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
