"""Block motion over pixels (stream_id, frame_no, y, x, r, g, b): search, residuals, vector edits, lags and activity.

``keys`` are the columns that tell streams apart; frames are numbered within a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions import u64
from frameloom.functions.scalars import clamp, div_round, every, gate, half_away, index_jitter, luma_fast, quantized_vector, scaled_vector, short


STREAM = ("stream_id",)


def block_grid(spark: SparkSession, width: int, height: int, size: int) -> DataFrame:
    """Blocks (block_index, x, y, w, h) in raster order, cut at the right and bottom edges."""
    columns, rows = -(-width // size), -(-height // size)
    i = F.col("id")
    x, y = (i % columns * size).cast("int"), F.floor(i / columns).cast("int") * size
    return spark.range(columns * rows).select(
        i.cast("int").alias("block_index"), x.alias("left_x"), y.alias("top_y"), F.least(F.lit(size), width - x).alias("w"), F.least(F.lit(size), height - y).alias("h")
    )


def candidates(spark: SparkSession, radius: int, step: int) -> DataFrame:
    """Vectors (ordinal, dx, dy), dy outer."""
    n = 2 * radius // step + 1
    i = F.col("id")
    return spark.range(n * n).select(i.cast("int").alias("ordinal"), (i % n * step - radius).cast("int").alias("dx"), (F.floor(i / n).cast("int") * step - radius).alias("dy"))


def block_sad(pixels: DataFrame, width: int, height: int, size: int = 16, radius: int = 8, step: int = 4, keys: tuple[str, ...] = STREAM) -> DataFrame:
    """Sum of luma differences of each block and vector to the previous frame, on sub-sampled pixels.

    The vectors are few and fixed by the parameters, so they are repeated beside each sample; the join with the
    frame before is on whole positions.
    """
    spark = pixels.sparkSession
    each = max(2, size // 4)
    columns = -(-width // size)
    lum = pixels.select(*keys, "frame_no", "y", "x", luma_fast("r", "g", "b").alias("luma"))
    block = (F.floor(F.col("y") / size) * columns + F.floor(F.col("x") / size)).cast("int")
    samples = lum.filter((F.col("y") % size % each == 0) & (F.col("x") % size % each == 0)).withColumn("block_index", block)
    moved = samples.crossJoin(F.broadcast(candidates(spark, radius, step))).select(
        *keys, "frame_no", "block_index", "ordinal", "dx", "dy", "luma",
        (F.col("frame_no") - 1).alias("ref_no"), clamp(F.col("y") + F.col("dy"), 0, height - 1).alias("ref_y"), clamp(F.col("x") + F.col("dx"), 0, width - 1).alias("ref_x"),
    )
    ref = lum.select(*keys, F.col("frame_no").alias("ref_no"), F.col("y").alias("ref_y"), F.col("x").alias("ref_x"), F.col("luma").alias("ref_luma"))
    return moved.join(ref, [*keys, "ref_no", "ref_y", "ref_x"]).groupBy(*keys, "frame_no", "block_index", "ordinal", "dx", "dy").agg(F.sum(F.abs(F.col("luma") - F.col("ref_luma"))).alias("sad"))


def motion_search(pixels: DataFrame, width: int, height: int, size: int = 16, radius: int = 8, step: int = 4, keys: tuple[str, ...] = STREAM) -> DataFrame:
    """The best vector (frame_no, block_index, dx, dy, sad): least error, then shortest, then first in scan order."""
    sad = block_sad(pixels, width, height, size, radius, step, keys)
    best = F.min(F.struct("sad", (F.abs("dx") + F.abs("dy")).alias("cost"), "ordinal", "dx", "dy"))
    return sad.groupBy(*keys, "frame_no", "block_index").agg(best.alias("m")).select(*keys, "frame_no", "block_index", F.col("m.dx").alias("dx"), F.col("m.dy").alias("dy"), F.col("m.sad").alias("sad"))


def residual_plane(pixels: DataFrame, vectors: DataFrame, width: int, height: int, size: int = 16, keys: tuple[str, ...] = STREAM) -> DataFrame:
    """Differences (res_r, res_g, res_b) of each pixel to the previous frame at its block's vector."""
    columns = -(-width // size)
    block = (F.floor(F.col("y") / size) * columns + F.floor(F.col("x") / size)).cast("int")
    here = pixels.withColumn("block_index", block).join(vectors.select(*keys, "frame_no", "block_index", "dx", "dy"), [*keys, "frame_no", "block_index"])
    here = here.withColumns({"ref_no": F.col("frame_no") - 1, "ref_y": clamp(F.col("y") + F.col("dy"), 0, height - 1), "ref_x": clamp(F.col("x") + F.col("dx"), 0, width - 1)})
    ref = pixels.select(*keys, F.col("frame_no").alias("ref_no"), F.col("y").alias("ref_y"), F.col("x").alias("ref_x"), *(F.col(c).alias(f"ref_{c}") for c in "rgb"))
    return here.join(ref, [*keys, "ref_no", "ref_y", "ref_x"]).select(*keys, "frame_no", "block_index", "y", "x", "dx", "dy", *((F.col(c) - F.col(f"ref_{c}")).alias(f"res_{c}") for c in "rgb"))


def keyframes(frames: DataFrame, interval: int, keys: tuple[str, ...] = STREAM) -> DataFrame:
    """Whether each frame is a keyframe: the first, and each ``interval``-th after it."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("frame_no"))
    return frames.withColumn("ordinal", n).withColumn("keyframe", (F.col("ordinal") == 1) | every(interval, F.col("ordinal") - 1))


def block_remap(vectors: DataFrame, blocks: int, n: int, stride: int, keys: tuple[str, ...] = STREAM) -> DataFrame:
    """Each n-th block takes the vector of the block ``stride`` further on, around the end."""
    source = F.when(every(n, F.col("block_index") + 1), F.pmod(F.col("block_index") + stride, F.lit(blocks))).otherwise(F.col("block_index"))
    return _from_block(vectors, source, keys)


def _from_block(vectors: DataFrame, source: Column, keys: tuple[str, ...]) -> DataFrame:
    other = vectors.select(*keys, "frame_no", F.col("block_index").alias("source_index"), F.col("dx").alias("to_dx"), F.col("dy").alias("to_dy"))
    return vectors.withColumn("source_index", source.cast("int")).join(other, [*keys, "frame_no", "source_index"]).select(*keys, "frame_no", "block_index", "source_index", F.col("to_dx").alias("dx"), F.col("to_dy").alias("dy"))


def vector_bank(vectors: DataFrame, width: int, height: int, size: int, bank: int, stride: int, shuffle_every: int = 0, latch: int = 1, keys: tuple[str, ...] = STREAM) -> DataFrame:
    """Each block takes the vector at its own place in the bank of blocks ``stride`` further on.

    Where a hash of block, bank and latch bucket is divisible by ``shuffle_every``, the stride is hashed instead.
    """
    columns, rows = -(-width // size), -(-height // size)
    across, down = -(-columns // bank), -(-rows // bank)
    count = across * down
    i = F.col("block_index")
    column, row = i % columns, F.floor(i / columns)
    index = (F.floor(row / bank) * across + F.floor(column / bank)).cast("long")
    step = F.lit(stride).cast("long")
    if shuffle_every and count > 1:
        seed = u64.dot((i, u64.SLOT_BLOCK), (index, u64.MIX_B), (F.floor(F.col("frame_no") / max(1, latch)), u64.SLOT_FRAME))
        hashed = 1 + u64.modulo(u64.mix(seed.bitwiseXOR(F.lit(u64.signed(u64.MIX_A)))), count - 1)
        step = F.when(u64.modulo(u64.mix(seed), shuffle_every) == 0, hashed).otherwise(step)
    source = F.pmod(index + step, F.lit(count)) if count > 1 else index
    to_column = F.least(source % across * bank + column % bank, F.lit(columns - 1))
    to_row = F.least(F.floor(source / across) * bank + row % bank, F.lit(rows - 1))
    return _from_block(vectors, to_row * columns + to_column, keys)


def _neighbour(vectors: DataFrame, columns: int) -> DataFrame:
    return vectors.withColumns({"row": F.floor(F.col("block_index") / columns).cast("int"), "column": F.col("block_index") % columns})


def clean_predictor(vectors: DataFrame, columns: int, keys: tuple[str, ...] = STREAM) -> DataFrame:
    """The truncated mean (pred_dx, pred_dy) of the left and the upper block's vectors."""
    at = _neighbour(vectors, columns)
    left = Window.partitionBy(*keys, "frame_no", "row").orderBy("column")
    top = Window.partitionBy(*keys, "frame_no", "column").orderBy("row")
    out = at
    for c in ("dx", "dy"):
        a, b = F.lag(c).over(left), F.lag(c).over(top)
        n = a.isNotNull().cast("int") + b.isNotNull().cast("int")
        total = F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        mean = F.when(n == 0, 0).otherwise((F.signum(total.cast("double")) * F.floor(F.abs(total) / F.greatest(n, F.lit(1)))).cast("int"))
        out = out.withColumn(f"pred_{c}", mean)
    return out.select(*keys, "frame_no", "block_index", "pred_dx", "pred_dy")


def diffusion(vectors: DataFrame, columns: int, strength: float, scale: float = 1.0, keys: tuple[str, ...] = STREAM) -> DataFrame:
    """Vectors moved toward the mean of the 3 x 3 blocks around them: each block is sent to its neighbours."""
    at = _neighbour(vectors, columns).withColumns({"sx": scaled_vector(F.col("dx"), scale), "sy": scaled_vector(F.col("dy"), scale)})
    offsets = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1)))
    sent = at.select(*keys, "frame_no", "sx", "sy", "row", "column", F.explode(offsets).alias("o"))
    mean = sent.groupBy(*keys, "frame_no", (F.col("row") + F.col("o.r")).alias("row"), (F.col("column") + F.col("o.c")).alias("column")).agg(F.avg("sx").alias("mx"), F.avg("sy").alias("my"))
    toward = lambda v, m: short(half_away(F.col(v) + (F.col(m) - F.col(v)) * F.lit(strength)))
    return at.join(mean, [*keys, "frame_no", "row", "column"]).select(*keys, "frame_no", "block_index", toward("sx", "mx").alias("dx"), toward("sy", "my").alias("dy"))


def vector_chain(vectors: DataFrame, scale_x: float = 1.0, scale_y: float = 1.0, quant: int = 1, jitter: int = 0, keys: tuple[str, ...] = STREAM) -> DataFrame:
    """Scale, quantize, then jitter by block index."""
    i = F.col("block_index")
    dx = short(quantized_vector(scaled_vector(F.col("dx"), scale_x), quant) + index_jitter(i, 0, jitter))
    dy = short(quantized_vector(scaled_vector(F.col("dy"), scale_y), quant) + index_jitter(i, 1, jitter))
    return vectors.select(*keys, "frame_no", "block_index", dx.alias("dx"), dy.alias("dy"))


def block_activity(residual: DataFrame, keys: tuple[str, ...] = STREAM) -> DataFrame:
    """Score of a block: the whole mean of its absolute residuals and four times its vector's cost."""
    total = sum((F.abs(f"res_{c}") for c in "gb"), F.abs("res_r"))
    out = residual.groupBy(*keys, "frame_no", "block_index").agg(F.sum(total).alias("s"), (F.count("*") * 3).alias("n"), F.max(F.abs("dx") + F.abs("dy")).alias("cost"))
    return out.select(*keys, "frame_no", "block_index", (F.floor(F.col("s") / F.col("n")) + 4 * F.col("cost")).cast("long").alias("score"))


def pixel_activity(residual: DataFrame) -> DataFrame:
    total = F.abs("res_r") + F.abs("res_g") + F.abs("res_b")
    return residual.withColumn("score", (F.floor(total / 3) + 2 * (F.abs("dx") + F.abs("dy"))).cast("long"))


def activity_mix(score: Column, mode: str, threshold: float, softness: float) -> Column:
    """1 for mode all; the gate for active; its complement for static."""
    if mode == "all":
        return F.lit(1.0)
    g = gate(score, threshold, softness)
    return g if mode == "active" else 1.0 - g


def latch_bucket(frame_no: Column, latch: int) -> Column:
    return F.floor(frame_no / max(1, latch))


def slice_lag(y: Column, frame_no: Column, height: int, span: int, drift: int, latch: int, lag: int = 1, available: int | None = None) -> Column:
    """Lag of a row by its slice and the drifting latch bucket."""
    limit = max(1, min(span, available or span))
    offset = F.pmod(F.floor(y / height) + latch_bucket(frame_no, latch) * drift, F.lit(limit))
    return (1 + (lag - 1 + offset) % limit).cast("int")


def scanline_lag(y: Column, x: Column, frame_no: Column, height: int, span: int, latch: int, lag: int = 1) -> Column:
    """Lag of a sample by a hash of its band of rows, its 32 columns and the latch bucket."""
    seed = u64.dot((F.floor(y / height), u64.SLOT_BLOCK), (F.floor(x / 32), u64.MIX_B), (latch_bucket(frame_no, latch), u64.SLOT_FRAME))
    return (1 + (lag - 1 + u64.modulo(u64.mix(seed), span)) % span).cast("int")


def switch(chance: Column, seed: Column) -> Column:
    """Whether the hashed unit value is under the chance."""
    return u64.unit(seed).cast("double") < chance


def bleed(activity: Column, amount: float) -> Column:
    return F.lit(amount) + clamp(activity, 0.0, 1.0) * (1 - amount)


def shifted_residual(residual: DataFrame, width: int, height: int, shift_x: int, shift_y: int, channel_shift: int = 0, gain: float = 1.0, keys: tuple[str, ...] = STREAM) -> DataFrame:
    """Residuals read at a shifted, clamped place, with channels rotated and a gain of at most 2 either way."""
    gain = max(-2.0, min(2.0, gain))
    own = residual.select(*keys, "frame_no", "y", "x", clamp(F.col("y") + shift_y, 0, height - 1).alias("sy"), clamp(F.col("x") + shift_x, 0, width - 1).alias("sx"))
    names = [f"res_{c}" for c in "rgb"]
    source = residual.select(*keys, "frame_no", F.col("y").alias("sy"), F.col("x").alias("sx"), *((F.col(names[(k + channel_shift) % 3]) * F.lit(gain)).alias(n) for k, n in enumerate(names)))
    return own.join(source, [*keys, "frame_no", "sy", "sx"]).select(*keys, "frame_no", "y", "x", *names)


def sign_flip_delta(vectors: DataFrame, flip_every: int, delta_every: int, delta: tuple[int, int]) -> DataFrame:
    """Vector edits of a packet: negate each n-th, then add to each m-th, saturating."""
    k = F.col("block_index") + 1
    out = vectors
    for c, d in zip(("dx", "dy"), delta, strict=True):
        v = F.when(every(flip_every, k), short(-F.col(c))).otherwise(F.col(c))
        out = out.withColumn(c, F.when(every(delta_every, k), short(v + d)).otherwise(v).cast("int"))
    return out


def address_shift(blocks: DataFrame, width: int, height: int, n: int, by: tuple[int, int]) -> DataFrame:
    """Each n-th block's corner moved within the frame, around its edges."""
    hit = every(n, F.col("block_index") + 1)
    x = F.pmod(F.col("left_x") + by[0], width - F.col("w") + 1)
    y = F.pmod(F.col("top_y") + by[1], height - F.col("h") + 1)
    return blocks.withColumns({"left_x": F.when(hit, x).otherwise(F.col("left_x")).cast("int"), "top_y": F.when(hit, y).otherwise(F.col("top_y")).cast("int")})


def mean_vector(vectors: DataFrame, keys: tuple[str, ...] = STREAM) -> DataFrame:
    return vectors.groupBy(*keys, "frame_no").agg(div_round(F.sum("dx"), 1).alias("sum_dx"), F.count("*").alias("blocks"))
