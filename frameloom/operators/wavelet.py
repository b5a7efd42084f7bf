"""Integer Haar wavelets by lifting, band layout, routing, quantization and per-coefficient edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.scalars import div_round, every, short, wavelet_step

ORIENTATIONS = ("approximation", "horizontal", "vertical", "diagonal")


def level_sizes(width: int, height: int, levels: int) -> list[tuple[int, int]]:
    """Sizes of the low quadrant after 0, 1, … levels: halves rounded up."""
    out = [(width, height)]
    for _ in range(levels):
        w, h = out[-1]
        out.append(((w + 1) // 2, (h + 1) // 2))
    return out


def max_levels(width: int, height: int) -> int:
    n = 0
    while width > 1 and height > 1:
        width, height, n = (width + 1) // 2, (height + 1) // 2, n + 1
    return n


def layout(width: int, height: int, levels: int, quality: int = 82) -> list[tuple]:
    """Bands (band_index, channel, level, orientation, w, h, step): by channel the approximation, then H, V, D of levels 1 to the last."""
    sizes = level_sizes(width, height, levels)
    out = []
    for channel in range(3):
        out.append((len(out), channel, levels, 0, *sizes[levels], wavelet_step(quality, levels, levels, False, channel)))
        for level in range(1, levels + 1):
            (w, h), (lw, lh) = sizes[level - 1], sizes[level]
            for orientation, (bw, bh) in enumerate(((w - lw, lh), (lw, h - lh), (w - lw, h - lh)), 1):
                out.append((len(out), channel, level, orientation, bw, bh, wavelet_step(quality, levels, level, True, channel)))
    return out


def layout_table(spark: SparkSession, width: int, height: int, levels: int, quality: int = 82) -> DataFrame:
    return spark.createDataFrame(layout(width, height, levels, quality), "band_index int, channel int, level int, orientation int, w int, h int, step int")


def lift(rows: DataFrame, axis: str, keys: list[str], value: str = "v") -> DataFrame:
    """One lifting step along ``axis``: pairs become (part low, high); an odd tail is low as it is."""
    even, odd = F.max(F.when(F.col(axis) % 2 == 0, F.col(value))), F.max(F.when(F.col(axis) % 2 == 1, F.col(value)))
    pairs = rows.groupBy(*keys, F.floor(F.col(axis) / 2).cast("int").alias("pair")).agg(even.alias("even"), odd.alias("odd"))
    high = F.col("odd") - F.col("even")
    low = F.when(F.col("odd").isNull(), F.col("even")).otherwise(F.col("even") + F.shiftright(high, 1))
    both = F.array(F.struct(F.lit(0).alias("part"), low.alias("v")), F.struct(F.lit(1).alias("part"), high.alias("v")))
    out = pairs.select(*keys, "pair", F.explode(both).alias("b"))
    return out.select(*keys, F.col("pair").alias(axis), F.col("b.part").alias(f"part_{axis}"), F.col("b.v").alias("v")).filter("v IS NOT NULL")


def unlift(rows: DataFrame, axis: str, keys: list[str], value: str = "v") -> DataFrame:
    """The inverse of ``lift``."""
    part = f"part_{axis}"
    low, high = F.max(F.when(F.col(part) == 0, F.col(value))), F.max(F.when(F.col(part) == 1, F.col(value)))
    pairs = rows.groupBy(*keys, F.col(axis).alias("pair")).agg(low.alias("low"), high.alias("high"))
    even = F.when(F.col("high").isNull(), F.col("low")).otherwise(F.col("low") - F.shiftright("high", 1))
    both = F.array(F.struct(F.lit(0).alias("o"), even.alias("v")), F.struct(F.lit(1).alias("o"), (even + F.col("high")).alias("v")))
    out = pairs.select(*keys, "pair", F.explode(both).alias("b"))
    return out.select(*keys, (F.col("pair") * 2 + F.col("b.o")).cast("int").alias(axis), F.col("b.v").alias("v")).filter("v IS NOT NULL")


def haar(plane: DataFrame, levels: int, keys: list[str]) -> DataFrame:
    """Coefficients (keys, level, orientation, y, x, v) of planes (keys, y, x, v)."""
    low, bands = plane, None
    for level in range(1, levels + 1):
        rows = lift(low, "x", [*keys, "y"])
        both = lift(rows, "y", [*keys, "x", "part_x"])
        tagged = both.withColumns({"level": F.lit(level), "orientation": F.col("part_x") + 2 * F.col("part_y")})
        here = tagged.select(*keys, "level", "orientation", "y", "x", "v")
        detail = here.filter("orientation > 0")
        bands = detail if bands is None else bands.unionByName(detail)
        low = here.filter("orientation = 0").select(*keys, "y", "x", "v")
    return bands.unionByName(low.withColumns({"level": F.lit(levels), "orientation": F.lit(0)}).select(*bands.columns))


def unhaar(bands: DataFrame, levels: int, keys: list[str]) -> DataFrame:
    low = bands.filter("orientation = 0").select(*keys, "y", "x", "v")
    for level in range(levels, 0, -1):
        here = bands.filter((F.col("level") == level) & (F.col("orientation") > 0)).select(*keys, "y", "x", "orientation", "v")
        rows = here.unionByName(low.withColumn("orientation", F.lit(0)))
        rows = rows.withColumns({"part_x": F.col("orientation") % 2, "part_y": F.floor(F.col("orientation") / 2).cast("int")})
        low = unlift(unlift(rows, "y", [*keys, "x", "part_x"]), "x", [*keys, "y"])
    return low


def quantized(bands: DataFrame, spark: SparkSession, width: int, height: int, levels: int, quality: int) -> DataFrame:
    """Coefficients divided by their band's step, rounded half away from zero, as 16 bits."""
    steps = F.broadcast(layout_table(spark, width, height, levels, quality).select("band_index", "channel", "level", "orientation", "w", "step"))
    return bands.join(steps, ["channel", "level", "orientation"]).withColumn("c", short(div_round(F.col("v"), F.col("step"))))


def route(spark: SparkSession, frames: DataFrame, width: int, height: int, levels: int, *, rotate_n=0, rotate=1, fold_n=0, fold=1, channel_n=0, channel=1, shift_n=0, shift=1, loss_n=0, history_n=0, lag=1, lowpass_lag=0, conceal=True, keys: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """Which band each band of each frame reads: (keys, frame_no, band_index, ref_no, source_index); no source if lost.

    Rules follow one another, each from the band's own place, so a later rule wins: history, orientation, level,
    channel, shift, loss. An event's ordinal is band + frame, from 0.
    """
    table = layout(width, height, levels)
    bands = len(table)
    find = {(c, lv, o): i for i, c, lv, o, *_ in table}
    routes = []
    for i, c, lv, o, *_ in table:
        turned = find.get((c, lv, (o - 1 + rotate) % 3 + 1)) if o else i
        folded = find.get((c, (lv - 1 + fold) % levels + 1, o))
        crossed = find.get(((c + channel) % 3, lv, o))
        routes.append((i, o, turned, folded, crossed, (i + shift) % bands))
    dim = spark.createDataFrame(routes, "band_index int, orientation int, turned int, folded int, crossed int, moved int")
    k = F.col("band_index") + F.col("frame_no")
    rows = frames.select(*keys, "frame_no").crossJoin(F.broadcast(dim))
    hit = lambda n: F.lit(False) if n == 0 else k % n == 0
    flat = F.col("orientation") == 0
    back = F.when(flat & F.lit(lowpass_lag > 0), F.lit(lowpass_lag)).when(~(flat & F.lit(lowpass_lag > 0)) & hit(history_n), F.lit(max(1, lag))).otherwise(0)
    ref = F.when((back > 0) & (F.col("frame_no") >= back), F.col("frame_no") - back).otherwise(F.col("frame_no"))
    source = F.col("band_index")
    for n, c in ((rotate_n, "turned"), (fold_n, "folded"), (channel_n, "crossed"), (shift_n, "moved")):
        ref = F.when(hit(n) & F.col(c).isNotNull(), F.col("frame_no")).otherwise(ref)
        source = F.when(hit(n) & F.col(c).isNotNull(), F.col(c)).otherwise(source)
    lost = hit(loss_n)
    can = F.lit(conceal) & (F.col("frame_no") >= max(1, lag))
    ref = F.when(lost & can, F.col("frame_no") - max(1, lag)).when(lost, F.lit(None).cast("int")).otherwise(ref)
    source = F.when(lost & can, F.col("band_index")).when(lost, F.lit(None).cast("int")).otherwise(source)
    return rows.select(*keys, "frame_no", "band_index", ref.cast("int").alias("ref_no"), source.cast("int").alias("source_index"))


def ordinal(band: Column, frame_no: Column, y: Column, x: Column, width: Column) -> Column:
    """The ordinal of a coefficient, from 0."""
    return (band + frame_no).cast("long") * 1000003 + y * width + x


def plane_edits(c: Column, k: Column, *, clear=0, clear_n=0, flip=0, flip_n=0, negate_n=0) -> Column:
    """Low bits of the magnitude cleared, a bit of it flipped, the sign changed, each at its own every-Nth."""
    sign = F.when(c < 0, -1).otherwise(1)
    if clear and clear_n:
        c = F.when(k % clear_n == 0, sign * F.shiftleft(F.shiftright(F.abs(c), clear), clear)).otherwise(c)
    if flip and flip_n:
        sign = F.when(c < 0, -1).otherwise(1)
        c = F.when(k % flip_n == 0, short(sign * F.abs(c).bitwiseXOR(F.lit(1 << (flip - 1))))).otherwise(c)
    if negate_n:
        c = F.when(k % negate_n == 0, short(-c)).otherwise(c)
    return c.cast("int")


def varint_bytes(v: Column) -> Column:
    """Bytes of a number in groups of 7 bits."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(v.cast("long"))) / 7)).cast("int")


def folded_sign(v: Column) -> Column:
    """Small numbers for small magnitudes: 2v, or -2v - 1 for a negative one."""
    return F.when(v >= 0, 2 * v).otherwise(-2 * v - 1)


def every_band(n: int, band: Column, frame_no: Column) -> Column:
    return every(n, band + frame_no)
