"""Frame sources: formulas, raw files, binary frames, and display scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.scalars import col


def grid(spark: SparkSession, frames: int, width: int, height: int) -> DataFrame:
    """A row (frame_no, y, x) for each pixel, made where it is used."""
    i = F.col("id")
    return spark.range(frames * width * height).select(
        F.floor(i / (width * height)).cast("int").alias("frame_no"),
        F.floor(i % (width * height) / width).cast("int").alias("y"),
        (i % width).cast("int").alias("x"),
    )


def tiles(vectors: DataFrame, width: int, height: int, frames: int, *, id_col: str = "vec_id", values_col: str = "embedding") -> DataFrame:
    """Vectors of 64 numbers as the 8 x 8 tiles of frames: pixels (stream_id, frame_no, y, x, r, g, b).

    Vector n is tile n of one long row of frames, ``frames`` of them a stream; what lacks at the end of the last stream
    is dark. Red is the level of a value, green drifts over it, blue is the moving bars over a pattern of the stream.
    """
    across, each = width // 8, width // 8 * (height // 8)
    whole = vectors.sparkSession.range(-(-(vectors.agg((F.max(id_col) + 1).alias("n")).first().n or 0) // (each * frames)) * each * frames)
    n, dark = F.col("id"), F.array_repeat(F.lit(0.0), 64)
    rows = whole.join(vectors.select(F.col(id_col).alias("id"), F.col(values_col).alias("values")), "id", "left")
    rows = rows.select("id", F.posexplode(F.coalesce(F.col("values").cast("array<double>"), dark)).alias("p", "v"))
    level = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("v") * 256) + 128)).cast("int")
    rows = rows.select(
        F.floor(n / (each * frames)).cast("int").alias("stream_id"), (F.floor(n / each) % frames).cast("int").alias("frame_no"),
        (F.floor(n % each / across) * 8 + F.floor(F.col("p") / 8)).cast("int").alias("y"), (n % each % across * 8 + F.col("p") % 8).cast("int").alias("x"), level.alias("r"),
    )
    f, x, y = F.col("frame_no"), F.col("x"), F.col("y")
    bars = (F.abs(x - 3 * f % width) < 24) | (F.abs(y - 2 * f % height) < 12)
    return rows.withColumn("g", _low(F.col("r") + 2 * y + 3 * f)).withColumn("b", F.when(bars, F.lit(240)).otherwise(_low(x.bitwiseXOR(y) + 7 * F.col("stream_id"))))


def _low(c: Column) -> Column:
    return c.bitwiseAND(F.lit(255)).cast("int")


def moving_bars(spark: SparkSession, frames: int, width: int, height: int) -> DataFrame:
    """Pixels (frame_no, y, x, r, g, b) of two moving bars over a pattern."""
    f, x, y = F.col("frame_no"), F.col("x"), F.col("y")
    bars = (F.abs(x - 3 * f % width) < 24) | (F.abs(y - 2 * f % height) < 12)
    return grid(spark, frames, width, height).select(
        "frame_no", "y", "x", _low(x + f).alias("r"), _low(2 * y + 3 * f).alias("g"),
        F.when(bars, F.lit(240)).otherwise(_low(x.bitwiseXOR(y))).alias("b"),
    )


def drifting_xor(spark: SparkSession, frames: int, width: int, height: int) -> DataFrame:
    """Pixels of three drifting ramps."""
    f, x, y = F.col("frame_no"), F.col("x"), F.col("y")
    return grid(spark, frames, width, height).select("frame_no", "y", "x", _low(x + 3 * f).alias("r"), _low(2 * y + 5 * f).alias("g"), _low(x.bitwiseXOR(y) + 7 * f).alias("b"))


def raw_frames(spark: SparkSession, path: str, width: int, height: int, *, channels: int = 3, strict: bool = True) -> DataFrame:
    """Frames (stream_id, frame_no, width, height, pixels) of raw video files: whole frames one after the other.

    A partial last frame is an error if ``strict``, else it is left out.
    """
    size = width * height * channels
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("stream_id"), "content", F.length("content").alias("n"))
    if strict:
        files = files.withColumn("n", F.when(F.col("n") % size == 0, F.col("n")).otherwise(F.raise_error(F.lit("a file ends inside a frame")).cast("int")))
    whole = F.floor(F.col("n") / size).cast("int")
    return files.filter(whole > 0).select("stream_id", "content", F.explode(F.sequence(F.lit(0), whole - 1)).alias("frame_no")).select(
        "stream_id", F.col("frame_no").cast("long").alias("frame_no"), F.lit(width).alias("width"), F.lit(height).alias("height"),
        F.substring("content", F.col("frame_no") * size + 1, F.lit(size)).alias("pixels"),
    )


def byte_at(data: Column | str, at: Column) -> Column:
    """The byte at a 0-based place, 0 to 255."""
    return F.conv(F.hex(F.substring(col(data), at + 1, F.lit(1))), 16, 10).cast("int")


def explode_frames(frames: DataFrame, channels: int = 3) -> DataFrame:
    """Binary frames as pixels (…, y, x, r, g, b[, a])."""
    names = ("r", "g", "b", "a")[:channels]
    rows = frames.select("stream_id", "frame_no", "width", "pixels", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"))
    return rows.select(
        "stream_id", "frame_no", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"),
        *(byte_at("pixels", F.col("i") * channels + k).alias(c) for k, c in enumerate(names)),
    )


def assemble_frames(pixels: DataFrame, keys: tuple[str, ...] = ("stream_id", "frame_no"), names: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Pixels as binary frames (keys, width, height, pixels)."""
    one = F.concat(*(F.lpad(F.hex(F.col(c)), 2, "0") for c in names))
    rows = pixels.groupBy(*keys).agg(
        (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.array_sort(F.collect_list(F.struct("y", "x", one.alias("h")))).alias("p")
    )
    return rows.select(*keys, "width", "height", F.unhex(F.array_join(F.transform("p", lambda s: s["h"]), "")).alias("pixels"))


def normalize_pixels(pixels: DataFrame, kind: str) -> DataFrame:
    """Surface formats as 8-bit r, g, b, a: bgra8 and rgba8 as they are, rgba16 by its high byte, floats clamped and truncated."""
    def fit(c: str) -> Column:
        if kind in ("bgra8", "rgba8"):
            return F.col(c).cast("int")
        if kind == "rgba16":
            return F.shiftright(F.col(c).cast("int"), 8)
        if kind in ("rgba16f", "rgba32f"):
            return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c).cast("double"))) * 255).cast("int")
        raise ValueError("a pixel format is one of bgra8, rgba8, rgba16, rgba16f, rgba32f")

    return pixels.withColumns({c: fit(c) for c in ("r", "g", "b", "a")})


def scale_nearest(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Frames of ``size`` (width, height) scaled to ``to`` by repeating or skipping pixels."""
    (w, h), (ow, oh) = size, to
    places = lambda n, m, c: pixels.sparkSession.range(m).select(F.col("id").cast("int").alias(f"out_{c}"), F.floor(F.col("id") * n / m).cast("int").alias(c))
    return pixels.join(F.broadcast(places(w, ow, "x")), "x").join(F.broadcast(places(h, oh, "y")), "y").drop("x", "y").withColumnsRenamed({"out_x": "x", "out_y": "y"})


def scale_linear(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int], keys: tuple[str, ...] = ("stream_id", "frame_no")) -> DataFrame:
    """Bilinear scaling in 8.8 fixed point: each source pixel is weighed for the output pixels that it touches."""
    spark = pixels.sparkSession

    def taps(n: int, m: int, c: str) -> DataFrame:
        place = F.floor(F.col("id") * (n - 1) * 256 / max(1, m - 1)).cast("int")
        first, part = F.least(F.floor(place / 256), F.lit(n - 1)).cast("int"), place % 256
        second = F.least(first + 1, F.lit(n - 1))
        both = F.array(F.struct(first.alias("s"), (256 - part).alias("w")), F.struct(second.alias("s"), part.alias("w")))
        rows = spark.range(m).select(F.col("id").cast("int").alias(f"out_{c}"), F.explode(both).alias("t"))
        return rows.groupBy(f"out_{c}", F.col("t.s").alias(c)).agg(F.sum("t.w").alias(f"w_{c}"))

    near = pixels.join(F.broadcast(taps(size[0], to[0], "x")), "x").join(F.broadcast(taps(size[1], to[1], "y")), "y")
    weight = F.col("w_x") * F.col("w_y")
    return near.groupBy(*keys, F.col("out_y").alias("y"), F.col("out_x").alias("x")).agg(
        *(F.shiftright(F.sum(F.col(c) * weight) + 32768, 16).cast("int").alias(c) for c in ("r", "g", "b"))
    )
