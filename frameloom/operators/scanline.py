"""The line signal: predictor choice, residuals, run lengths, field order, phase walks and record edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.scalars import clamp, div_round, every


STREAM = ("stream_id",)


def predictor_choice(luma: DataFrame, keys: tuple[str, ...] = STREAM) -> DataFrame:
    """For each line (keys, frame_no, y) whether the previous frame predicts it better than the sample to the left, which
    starts from 0; rows (keys, frame_no, y, x, luma)."""
    left = F.lag("luma", 1, 0).over(Window.partitionBy(*keys, "frame_no", "y").orderBy("x"))
    ref = luma.select(*keys, (F.col("frame_no") + 1).alias("frame_no"), "y", "x", F.col("luma").alias("ref"))
    rows = luma.withColumn("left", left).join(ref, [*keys, "frame_no", "y", "x"], "left")
    sums = rows.groupBy(*keys, "frame_no", "y").agg(F.sum(F.abs(F.col("luma") - F.col("left"))).alias("horizontal"), F.sum(F.abs(F.col("luma") - F.col("ref"))).alias("temporal"))
    return sums.withColumn("use_temporal", F.coalesce(F.col("temporal") < F.col("horizontal"), F.lit(False)))


def temporal_residual(luma: DataFrame, quant: int, keys: tuple[str, ...] = STREAM) -> DataFrame:
    """Quantized differences to the previous clean frame, as signed bytes."""
    ref = luma.select(*keys, (F.col("frame_no") + 1).alias("frame_no"), "y", "x", F.col("luma").alias("ref"))
    res = clamp(div_round(F.col("luma") - F.col("ref"), quant), -128, 127)
    return luma.join(ref, [*keys, "frame_no", "y", "x"]).select(*keys, "frame_no", "y", "x", res.cast("int").alias("res"))


def scan_order(y: Column) -> Column:
    """Place in the interlaced order: even lines, then odd ones."""
    return F.struct((y % 2).alias("field"), y.alias("line"))


def zero_runs(rows: DataFrame, keys: list[str], value: str = "res", order: str = "x") -> DataFrame:
    """Runs (keys, start, length, zero) of zeros and of other values, by gaps and islands."""
    by = Window.partitionBy(*keys).orderBy(order)
    turn = F.when(F.lag(F.col(value) == 0).over(by) == (F.col(value) == 0), 0).otherwise(1)
    marked = rows.withColumn("zero", F.col(value) == 0).withColumn("_turn", turn)
    marked = marked.withColumn("run_no", F.sum("_turn").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "run_no", "zero").agg(F.min(order).alias("start"), F.count("*").alias("length")).drop("run_no")


def run_bytes(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Coded bytes of each line: a token for up to 128 zeros, a token and its values for up to 128 others."""
    tokens = F.ceil(F.col("length") / 128)
    size = F.when(F.col("zero"), tokens).otherwise(tokens + F.col("length"))
    return runs.groupBy(*keys).agg(F.sum(size).cast("long").alias("bytes"))


def phase_turn(cb: Column, cr: Column, phase: Column) -> tuple[Column, Column]:
    """The carrier pair turned by quarters; the negative of -128 is 127."""
    minus = lambda c: F.least(F.lit(127), -c)
    a = F.when(phase == 0, cb).when(phase == 1, cr).when(phase == 2, minus(cb)).otherwise(minus(cr))
    b = F.when(phase == 0, cr).when(phase == 1, minus(cb)).when(phase == 2, minus(cr)).otherwise(cb)
    return a, b


def phase_walk(records: DataFrame, burst_n: int, offset: int, drift: int, keys: tuple[str, ...] = STREAM) -> DataFrame:
    """Phase bits of records (keys, frame_no, record_index, phase): a step at each lost burst by the parity of frame and
    record, an offset and a drift by index, modulo 4."""
    k = F.col("record_index") + 1
    hit = every(burst_n, k)
    step = F.when(hit, F.when((F.col("frame_no") + k) % 2 == 0, 1).otherwise(-1)).otherwise(0)
    walk = F.sum(step).over(Window.partitionBy(*keys, "frame_no").orderBy("record_index").rowsBetween(Window.unboundedPreceding, 0))
    return records.withColumn("walk", walk.cast("int")).withColumn("phase", F.pmod(F.col("phase") + F.col("walk") + offset + drift * F.col("record_index"), F.lit(4)).cast("int"))


def record_edits(records: DataFrame, height: int, *, sync_n=0, predictor_n=0, swap_n=0, quant_n=0, quant=0, shift_n=0, shift=0, shift_drift=0, index_n=0, index=0, stride=0, keys: tuple[str, ...] = STREAM) -> DataFrame:
    """Header edits of records (record_index, line, flags, quant, timing): sync lost, predictor bit, payload-swap bit,
    quantizer, line shift with drift, line index with stride."""
    i, k = F.col("record_index"), F.col("record_index") + 1
    flags = F.when(every(predictor_n, k), F.col("flags").bitwiseXOR(F.lit(1))).otherwise(F.col("flags"))
    flags = F.when(every(swap_n, k), flags.bitwiseXOR(F.lit(8))).otherwise(flags)
    return records.select(
        *keys, "frame_no", "record_index", flags.cast("int").alias("flags"), every(sync_n, k).alias("sync_lost"),
        F.when(every(quant_n, k), clamp(F.col("quant") + quant, 1, 255)).otherwise(F.col("quant")).cast("int").alias("quant"),
        F.when(every(shift_n, k), clamp(F.col("timing") + shift + shift_drift * i, -32768, 32767)).otherwise(F.col("timing")).cast("int").alias("timing"),
        F.when(every(index_n, k), F.pmod(F.col("line") + index + stride * i, F.lit(height))).otherwise(F.col("line")).cast("int").alias("line"),
    )


def concealed(lines: DataFrame, records: DataFrame, keys: tuple[str, ...] = STREAM) -> DataFrame:
    """Lines (keys, frame_no, line) that no record wrote."""
    return lines.join(records.select(*keys, "frame_no", "line").distinct(), [*keys, "frame_no", "line"], "left_anti")


def last_writer(records: DataFrame, keys: tuple[str, ...] = STREAM) -> DataFrame:
    """For each line the record that wrote it last."""
    return records.groupBy(*keys, "frame_no", "line").agg(F.max("record_index").alias("record_index"), F.count("*").alias("writes"))
