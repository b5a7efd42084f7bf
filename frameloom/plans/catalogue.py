"""The registered queries of the frame-stream operators. Their SQL is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions import scalars, u64
from frameloom.operators import controls, entropy, motion, scanline, transform, unit_columns, unit_filter, units, wavelet
from frameloom.plans import oracle, params
from frameloom.plans.engine import Engine, fold_frames
from frameloom.session import shared_folder, ship_package
from frameloom.sources import frames

W, H, N = oracle.WIDTH, oracle.HEIGHT, oracle.FRAMES
BLOCK, COLUMNS, ROWS = 16, W // 16, H // 16

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def footage(spark, sf_dir):
    """Streams of N frames whose tiles are the vectors of ``embeddings``: pixels (stream_id, frame_no, y, x, r, g, b)."""
    return frames.tiles(table(spark, sf_dir, "embeddings"), W, H, N)


def frame_list(spark, sf_dir):
    """The frames (stream_id, frame_no) of the footage."""
    tile = COLUMNS * ROWS * 4
    last = table(spark, sf_dir, "embeddings").agg(F.floor(F.max("vec_id") / (tile * N)).alias("last"))
    rows = last.select(F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))).alias("stream_id"))
    return rows.select("stream_id", F.explode(F.sequence(F.lit(0), F.lit(N - 1))).alias("frame_no"))


def vectors(spark, sf_dir):
    return motion.motion_search(footage(spark, sf_dir), W, H)


# Sources and colour


@query
def table_frames(spark, sf_dir):
    return footage(spark, sf_dir)


def _made(spark, sf_dir, formula):
    """Formula frames, as many as the footage has."""
    return formula(spark, frame_list(spark, sf_dir).count(), W, H)


@query
def synthetic_frames(spark, sf_dir):
    return _made(spark, sf_dir, frames.moving_bars)


@query
def synthetic_frames_xor(spark, sf_dir):
    return _made(spark, sf_dir, frames.drifting_xor)


@query
def frame_bytes_round_trip(spark, sf_dir):
    """Frames packed into binary rows and read back, byte for byte."""
    return frames.explode_frames(frames.assemble_frames(footage(spark, sf_dir)))


@query
def surface_formats(spark, sf_dir):
    wide = footage(spark, sf_dir).withColumns({c: F.col(c) * 257 for c in "rgb"}).withColumn("a", F.lit(65535))
    return frames.normalize_pixels(wide, "rgba16")


@query
def surface_floats(spark, sf_dir):
    wide = footage(spark, sf_dir).withColumns({c: F.col(c) / 200.0 for c in "rgb"}).withColumn("a", F.lit(0.5))
    return frames.normalize_pixels(wide, "rgba32f")


@query
def luma_plane(spark, sf_dir):
    return footage(spark, sf_dir).select("stream_id", "frame_no", "y", "x", scalars.luma_fast("r", "g", "b").alias("luma"))


def _ycbcr(spark, sf_dir):
    return footage(spark, sf_dir).select("*", *(c.alias(n) for c, n in zip(scalars.ycbcr("r", "g", "b"), ("luma", "cb", "cr"), strict=True)))


@query
def rgb_to_ycbcr(spark, sf_dir):
    return _ycbcr(spark, sf_dir).drop("r", "g", "b")


@query
def ycbcr_round_trip_error(spark, sf_dir):
    back = dict(zip(("br", "bg", "bb"), scalars.rgb("luma", "cb", "cr"), strict=True))
    off = sum((F.abs(F.col(c) - F.col(f"b{c}")) for c in "gb"), F.abs(F.col("r") - F.col("br")))
    return _ycbcr(spark, sf_dir).withColumns(back).groupBy("stream_id", "frame_no").agg(F.sum(off).alias("error"), F.max(off).alias("worst"))


@query
def ycocg_reversible(spark, sf_dir):
    rows = footage(spark, sf_dir).select("*", *(c.alias(n) for c, n in zip(scalars.ycocg("r", "g", "b"), ("luma", "co", "cg"), strict=True)))
    rows = rows.withColumns(dict(zip(("br", "bg", "bb"), scalars.ycocg_back("luma", "co", "cg"), strict=True)))
    same = (F.col("r") == F.col("br")) & (F.col("g") == F.col("bg")) & (F.col("b") == F.col("bb"))
    return rows.groupBy("stream_id", "frame_no").agg(F.count_if(~same).alias("wrong"), *(F.sum(c).alias(f"sum_{c}") for c in ("luma", "co", "cg")))


@query
def scale_nearest(spark, sf_dir):
    return frames.scale_nearest(footage(spark, sf_dir), (W, H), (70, 20)).select("stream_id", "frame_no", "y", "x", "r", "g", "b")


@query
def scale_linear(spark, sf_dir):
    return frames.scale_linear(footage(spark, sf_dir), (W, H), (70, 20))


# Block motion


@query
def block_grid(spark, sf_dir):
    return motion.block_grid(spark, W - 5, H - 3, BLOCK)


@query
def candidate_vectors(spark, sf_dir):
    return motion.candidates(spark, 8, 4)


@query
def block_sad(spark, sf_dir):
    return motion.block_sad(footage(spark, sf_dir), W, H)


@query
def motion_search(spark, sf_dir):
    return vectors(spark, sf_dir)


def _residual(spark, sf_dir):
    return motion.residual_plane(footage(spark, sf_dir), vectors(spark, sf_dir), W, H)


@query
def residual_plane(spark, sf_dir):
    return _residual(spark, sf_dir)


@query
def motion_search_residual(spark, sf_dir):
    r = _residual(spark, sf_dir)
    total = sum((F.abs(f"res_{c}") for c in "gb"), F.abs("res_r"))
    return r.groupBy("stream_id", "frame_no").agg(
        F.countDistinct("block_index").alias("blocks"), F.count_distinct(F.when((F.col("dx") != 0) | (F.col("dy") != 0), F.col("block_index"))).alias("moving"), F.sum(total).alias("residual")
    )


@query
def keyframe_decision(spark, sf_dir):
    return motion.keyframes(frame_list(spark, sf_dir), 4)


@query
def block_activity(spark, sf_dir):
    return motion.block_activity(_residual(spark, sf_dir))


@query
def activity_gate(spark, sf_dir):
    scored = motion.block_activity(_residual(spark, sf_dir))
    return scored.select("stream_id", "frame_no", "block_index", *(F.round(motion.activity_mix(F.col("score"), m, 12, 90), 9).alias(m) for m in ("all", "active", "static")))


@query
def pixel_activity(spark, sf_dir):
    return motion.pixel_activity(_residual(spark, sf_dir)).select("stream_id", "frame_no", "y", "x", "score")


@query
def block_remap(spark, sf_dir):
    return motion.block_remap(vectors(spark, sf_dir), COLUMNS * ROWS, 2, 5)


@query
def vector_bank(spark, sf_dir):
    return motion.vector_bank(vectors(spark, sf_dir), W, H, BLOCK, 2, 1)


@query
def vector_bank_shuffled(spark, sf_dir):
    return motion.vector_bank(vectors(spark, sf_dir), W, H, BLOCK, 1, 2, shuffle_every=2, latch=2)


@query
def vector_predictor_clean(spark, sf_dir):
    return motion.clean_predictor(vectors(spark, sf_dir), COLUMNS)


@query
def vector_diffusion(spark, sf_dir):
    return motion.diffusion(vectors(spark, sf_dir), COLUMNS, 0.5)


@query
def vector_chain(spark, sf_dir):
    return motion.vector_chain(vectors(spark, sf_dir), 1.22, 0.75, 3, 2)


@query
def vector_sign_flip_delta(spark, sf_dir):
    return motion.sign_flip_delta(vectors(spark, sf_dir), 2, 3, (7, -5))


@query
def block_address_shift(spark, sf_dir):
    return motion.address_shift(motion.block_grid(spark, W - 5, H - 3, BLOCK), W - 5, H - 3, 2, (9, -4))


@query
def residual_shift_rotate(spark, sf_dir):
    return motion.shifted_residual(_residual(spark, sf_dir), W, H, 2, -3, 1, 1.5)


@query
def temporal_slice_lag(spark, sf_dir):
    rows = frame_list(spark, sf_dir).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(H - 1))))
    return rows.withColumn("lag", motion.slice_lag(F.col("y"), F.col("frame_no"), 5, 8, -3, 2, 3))


@query
def scanline_lag(spark, sf_dir):
    rows = frame_list(spark, sf_dir).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(H - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(W - 1), F.lit(16))))
    return rows.withColumn("lag", motion.scanline_lag(F.col("y"), F.col("x"), F.col("frame_no"), 2, 5, 2))


@query
def latch_bucket(spark, sf_dir):
    rows = units.from_events(table(spark, sf_dir, "events"))
    return rows.groupBy("stream_id", motion.latch_bucket(F.col("seq"), 6).alias("bucket")).agg(F.count("*").alias("units"), F.sum(F.length("payload")).cast("long").alias("bytes"))


@query
def hash_mix(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return rows.withColumns({"mixed": F.hex(u64.mix(u64.times(F.col("l_orderkey"), u64.GOLDEN))), "split": F.hex(u64.splitmix(F.col("l_orderkey") * 8 + F.col("l_linenumber")))})


@query
def hash_unit_switch(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("x"), F.col("l_partkey").alias("y"))
    seed = u64.cell_seed(F.col("l_linenumber").cast("long"), F.col("x"), F.col("y"), F.col("l_orderkey"), 5, 2)
    return rows.select("l_orderkey", "l_linenumber", motion.switch(motion.bleed(F.lit(0.25), 0.12), seed).alias("dirty"))


@query
def index_jitter(spark, sf_dir):
    i = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(i, scalars.index_jitter(i, 0, 4).alias("jx"), scalars.index_jitter(i, 1, 4).alias("jy"))


# Cosine transform and entropy symbols


def _blocks(spark, sf_dir):
    """Luma blocks of frames that no side of 8 divides."""
    cropped = _ycbcr(spark, sf_dir).filter((F.col("x") < W - 1) & (F.col("y") < H - 1))
    return transform.blocks(cropped, W - 1, H - 1, "luma")


def _quantized(spark, sf_dir):
    return transform.quantized(_blocks(spark, sf_dir))


def _listed(rows):
    return transform.listed(rows).drop("u", "v", "q")


BLOCK_ID = ("stream_id", "frame_no", "block_no")


@query
def block_samples(spark, sf_dir):
    rows = _blocks(spark, sf_dir).select(*BLOCK_ID, F.posexplode("s").alias("pos", "s"))
    return rows.select(*BLOCK_ID, F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).cast("int").alias("x"), "s")


@query
def block_dct(spark, sf_dir):
    rows = transform.forward(_blocks(spark, sf_dir)).select(*BLOCK_ID, F.posexplode("f").alias("pos", "f"))
    f = F.round("f", 4)
    return rows.select(*BLOCK_ID, (F.col("pos") % 8).cast("int").alias("u"), F.floor(F.col("pos") / 8).cast("int").alias("v"), F.when(f == 0, 0.0).otherwise(f).alias("f"))


@query
def block_dct_energy(spark, sf_dir):
    rows = transform.forward(_blocks(spark, sf_dir))
    return rows.select(*BLOCK_ID, F.round(F.aggregate("f", F.lit(0.0), lambda a, f: a + f * f), 3).alias("energy"))


@query
def dct_quantize(spark, sf_dir):
    return transform.listed(_quantized(spark, sf_dir))


@query
def idct_round_trip(spark, sf_dir):
    """The largest error of a transform and its inverse is nothing but rounding."""
    back = transform.inverse(transform.forward(_blocks(spark, sf_dir).withColumn("t", F.col("s"))))
    off = F.array_max(F.zip_with("s", "t", lambda a, b: F.abs(a - b)))
    return back.select(*BLOCK_ID, F.round(off, 6).alias("worst"), F.size("t").cast("long").alias("n"))


@query
def zigzag_scan(spark, sf_dir):
    return _quantized(spark, sf_dir).select(*BLOCK_ID, F.array_join("c", ",").alias("scan"))


@query
def ac_rotate(spark, sf_dir):
    return _listed(transform.ac_rotated(_quantized(spark, sf_dir), 7))


@query
def zigzag_reverse(spark, sf_dir):
    return _listed(transform.zigzag_reversed(_quantized(spark, sf_dir)))


@query
def block_transpose(spark, sf_dir):
    return transform.listed(transform.transposed(_quantized(spark, sf_dir))).drop("zz", "q")


@query
def lowpass(spark, sf_dir):
    return _listed(transform.low_passed(_quantized(spark, sf_dir), 6))


@query
def requantize(spark, sf_dir):
    return _listed(transform.requantized(_quantized(spark, sf_dir), 2.5))


@query
def coefficient_sign_flip(spark, sf_dir):
    return _listed(transform.sign_flipped(_quantized(spark, sf_dir), 3, F.col("block_no") + 1))


@query
def dc_block_offset(spark, sf_dir):
    return transform.dc_values(transform.dc_offset(_quantized(spark, sf_dir), 5, F.col("block_no") + 1, 24)).withColumnRenamed("dc", "c")


@query
def dc_drift_running(spark, sf_dir):
    return transform.dc_drift(transform.dc_values(_quantized(spark, sf_dir)), 6, 12)


@query
def block_shift_repeat(spark, sf_dir):
    rows = frame_list(spark, sf_dir).withColumn("block_no", F.explode(F.sequence(F.lit(0), F.lit(W * H // 64 - 1))))
    return transform.block_sources(rows, W // 8, H // 8, 4, (3, 1), 5)


@query
def chroma_subsample_mean(spark, sf_dir):
    odd = _ycbcr(spark, sf_dir).filter((F.col("x") < W - 1) & (F.col("y") < H - 1))
    return transform.chroma_mean(odd, "cb")


@query
def dc_dpcm(spark, sf_dir):
    return entropy.dc_differences(transform.dc_values(_quantized(spark, sf_dir)))


@query
def ac_run_symbols(spark, sf_dir):
    return entropy.ac_symbols(_quantized(spark, sf_dir))


@query
def symbol_histogram(spark, sf_dir):
    return entropy.histogram(entropy.ac_symbols(_quantized(spark, sf_dir)))


# Wavelets


def _planes(spark, sf_dir):
    rows = footage(spark, sf_dir).filter((F.col("x") < W - 1) & (F.col("y") < H - 1))
    return rows.select("stream_id", "frame_no", "y", "x", F.posexplode(F.array(*scalars.ycocg("r", "g", "b"))).alias("channel", "v"))


LEVELS = 2


def _bands(spark, sf_dir):
    return wavelet.haar(_planes(spark, sf_dir), LEVELS, ["stream_id", "frame_no", "channel"])


def _coefficients(spark, sf_dir):
    return wavelet.quantized(_bands(spark, sf_dir), spark, W - 1, H - 1, LEVELS, 82)


@query
def haar_level1(spark, sf_dir):
    return wavelet.lift(_planes(spark, sf_dir), "x", ["stream_id", "frame_no", "channel", "y"])


@query
def haar_pyramid(spark, sf_dir):
    return _bands(spark, sf_dir)


@query
def haar_inverse_error(spark, sf_dir):
    back = wavelet.unhaar(_bands(spark, sf_dir), LEVELS, ["stream_id", "frame_no", "channel"]).withColumnRenamed("v", "w")
    return _planes(spark, sf_dir).join(back, ["stream_id", "frame_no", "channel", "y", "x"]).groupBy("stream_id", "frame_no", "channel").agg(F.sum(F.abs(F.col("v") - F.col("w"))).alias("error"), F.count("*").alias("n"))


@query
def band_layout(spark, sf_dir):
    return wavelet.layout_table(spark, W - 1, H - 1, LEVELS)


@query
def band_quantize(spark, sf_dir):
    return _coefficients(spark, sf_dir).select("stream_id", "frame_no", "band_index", "y", "x", "c")


@query
def band_router(spark, sf_dir):
    return wavelet.route(spark, frame_list(spark, sf_dir), W - 1, H - 1, LEVELS, rotate_n=3, fold_n=6, channel_n=4, shift_n=5, shift=2)


@query
def packet_loss_conceal(spark, sf_dir):
    return wavelet.route(spark, frame_list(spark, sf_dir), W - 1, H - 1, LEVELS, loss_n=5, lag=3, history_n=7, lowpass_lag=2)


@query
def bitplane_mutations(spark, sf_dir):
    k = wavelet.ordinal(F.col("band_index"), F.col("frame_no"), F.col("y"), F.col("x"), F.col("w"))
    return _coefficients(spark, sf_dir).select("stream_id", "frame_no", "band_index", "y", "x", wavelet.plane_edits(F.col("c"), k, clear=2, clear_n=3, flip=4, flip_n=11, negate_n=7).alias("c"))


@query
def rate_estimate(spark, sf_dir):
    """Estimated bytes of each frame: runs of zeros and values as variable-length numbers, and headers."""
    rows = _coefficients(spark, sf_dir).withColumn("place", F.col("y") * F.col("w") + F.col("x"))
    by = Window.partitionBy("stream_id", "frame_no", "band_index").orderBy("place")
    live = rows.filter("c <> 0").withColumn("run", F.col("place") - F.coalesce(F.lag("place").over(by), F.lit(-1)) - 1)
    size = wavelet.varint_bytes(F.col("run")) + wavelet.varint_bytes(wavelet.folded_sign(F.col("c")))
    return live.groupBy("stream_id", "frame_no").agg((F.sum(size) + 16 + 16 * 3 * (1 + 3 * LEVELS)).cast("long").alias("bytes"))


# Line signal


def _luma(spark, sf_dir):
    return _ycbcr(spark, sf_dir).select("stream_id", "frame_no", "y", "x", "luma")


@query
def line_predictor_choice(spark, sf_dir):
    return scanline.predictor_choice(_luma(spark, sf_dir))


@query
def temporal_line_residual(spark, sf_dir):
    return scanline.temporal_residual(_luma(spark, sf_dir), 2)


@query
def field_scan_order(spark, sf_dir):
    rows = spark.range(H).select(F.col("id").cast("int").alias("line"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(scanline.scan_order(F.col("line")))))


@query
def zero_rle_runs(spark, sf_dir):
    return scanline.zero_runs(scanline.temporal_residual(_luma(spark, sf_dir), 16), ["stream_id", "frame_no", "y"])


@query
def zero_rle_bytes(spark, sf_dir):
    return scanline.run_bytes(scanline.zero_runs(scanline.temporal_residual(_luma(spark, sf_dir), 16), ["stream_id", "frame_no", "y"]), ["stream_id", "frame_no", "y"])


@query
def text_zero_runs(spark, sf_dir):
    """Runs of letters and of other characters in conversations, as zeros and values of a line."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "")).alias("x", "ch")).filter("ch <> ''")
    return scanline.zero_runs(rows.withColumn("res", F.when(F.col("ch").rlike("^[a-z]$"), 0).otherwise(1)), ["conv_id", "turn"]).groupBy("conv_id", "turn").agg(
        F.count("*").alias("runs"), F.max("length").alias("longest"), F.sum(F.when(F.col("zero"), F.col("length")).otherwise(0)).alias("zeros")
    )


@query
def chroma_phase_turn(spark, sf_dir):
    phase = (F.col("frame_no") + F.col("y")) % 4
    a, b = scanline.phase_turn(F.col("cb") - 128, F.col("cr") - 128, phase)
    return _ycbcr(spark, sf_dir).select("stream_id", "frame_no", "y", "x", a.alias("a"), b.alias("b"))


def _records(spark, sf_dir):
    i = F.col("line")
    rows = frame_list(spark, sf_dir).withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(H - 1))))
    return rows.select(
        "stream_id", "frame_no", i.alias("record_index"), "line", (i % 8).alias("flags"), F.lit(2).alias("quant"), F.lit(0).alias("timing"),
        ((i + F.col("frame_no")) % 4).alias("phase"),
    )


@query
def phase_walk(spark, sf_dir):
    return scanline.phase_walk(_records(spark, sf_dir), 7, 1, 1).select("stream_id", "frame_no", "record_index", "walk", "phase")


@query
def line_record_edits(spark, sf_dir):
    return scanline.record_edits(_records(spark, sf_dir), H, sync_n=9, predictor_n=8, swap_n=11, quant_n=5, quant=4, shift_n=6, shift=12, shift_drift=1, index_n=13, index=1, stride=1)


def _edited(spark, sf_dir):
    return scanline.record_edits(_records(spark, sf_dir), H, sync_n=9, index_n=5, index=3, stride=1).filter("NOT sync_lost")


@query
def line_concealment(spark, sf_dir):
    return scanline.concealed(_records(spark, sf_dir).select("stream_id", "frame_no", "line"), _edited(spark, sf_dir))


@query
def line_last_writer(spark, sf_dir):
    return scanline.last_writer(_edited(spark, sf_dir))


# Units


def _units(spark, sf_dir):
    return units.kinds(units.from_events(table(spark, sf_dir, "events"))).drop("data", "code")


def _pictures(spark, sf_dir):
    """Events as MPEG-2 units: sign-ups are picture headers, purchases sequence headers, the others slices."""
    rows = units.from_events(table(spark, sf_dir, "events").withColumn("props", F.col("event_type"))).drop("data")
    kind = F.decode("payload", "UTF-8")
    bits = F.get(F.array(F.lit("08"), F.lit("10"), F.lit("18")), (F.col("event_id") % 3).cast("int"))
    slice_ = F.concat(F.lit("000001"), F.lpad(F.lower(F.hex(F.col("event_id") % 175 + 1)), 2, "0"))
    data = F.when(kind == "signup", F.concat(F.lit("0000010000"), bits)).when(kind == "purchase", F.lit("000001b3")).otherwise(slice_)
    out = unit_columns.classified(rows.withColumn("data", F.unhex(data)), "mpeg2")
    return out.withColumn("kind", F.when(F.col("role") == "picture", "header").when(F.col("role") == "header", "key").otherwise("predicted"))


@query
def unit_roles(spark, sf_dir):
    return _pictures(spark, sf_dir).select("stream_id", "seq", "code", "role", "picture")


@query
def unit_classify(spark, sf_dir):
    return units.ordinals(_units(spark, sf_dir)).drop("payload")


@query
def keyframe_drop_recover(spark, sf_dir):
    return units.drop_keyframes(_units(spark, sf_dir), 1, 3).drop("payload")


@query
def drop_every_nth(spark, sf_dir):
    return units.drop_every(_units(spark, sf_dir), 3).drop("payload")


@query
def header_dedup(spark, sf_dir):
    rows = units.kinds(units.from_events(table(spark, sf_dir, "events")))
    return units.first_headers(rows, F.col("code")).drop("payload", "data", "code")


@query
def picture_types(spark, sf_dir):
    rows = units.carried(_pictures(spark, sf_dir), F.col("picture"), "current")
    return rows.select("stream_id", "seq", "kind", "current")


@query
def skip_until_next_picture(spark, sf_dir):
    return units.skip_pictures(_pictures(spark, sf_dir), F.col("picture"), 1, 4).select("stream_id", "seq", "kind", "picture", "i_no")


@query
def echo_repeat_units(spark, sf_dir):
    return units.echo_and_repeat(_units(spark, sf_dir), 2, 1, 3, 2)


@query
def replace_with_previous(spark, sf_dir):
    return units.replaced(_units(spark, sf_dir), 4).withColumn("payload", F.decode("payload", "UTF-8"))


@query
def donor_pick(spark, sf_dir):
    rows = units.with_donor(_units(spark, sf_dir), units.donors(_units(spark, sf_dir), 1, 16))
    return rows.select("stream_id", "seq", "slot", F.decode("donor", "UTF-8").alias("donor"))


@query
def slice_address_shift(spark, sf_dir):
    a = F.col("event_id") % 175 + 1
    return table(spark, sf_dir, "events").select("event_id", units.shifted_address(a, -7).alias("shifted"), units.address_dropped(a, 4, 6).alias("dropped"))


def _pairs(spark, sf_dir):
    rows = units.with_previous(_units(spark, sf_dir), 5)
    return rows.filter("previous IS NOT NULL")


def _payload_query(name, edit):
    def run(spark, sf_dir):
        seed = F.col("predicted_no")
        return _pairs(spark, sf_dir).select("stream_id", "seq", F.decode(edit(F.col("payload"), F.col("previous"), seed), "UTF-8").alias("payload"))

    run.__name__ = name
    QUERIES[name] = run


_payload_query("payload_truncate", lambda p, o, s: units.truncated(p, 9))
_payload_query("payload_splice", lambda p, o, s: units.spliced(p, o, s, 6))
_payload_query("payload_grow", lambda p, o, s: units.grown(p, o, s, 5))
_payload_query("payload_rotate", lambda p, o, s: units.rotated_window(p, s, 8))


@query
def mutation_stats(spark, sf_dir):
    return units.mutation_counts(_units(spark, sf_dir), 5, 2, 3, 2)


# Controls


@query
def control_messages(spark, sf_dir):
    """Messages made of events: presets, values, comments, controls and lines that are none of them."""
    value = F.col("value").cast("string")
    message = (
        F.when(F.col("event_type") == "signup", F.lit("preset melt")).when(F.col("event_type") == "purchase", F.concat(F.lit("set mv_scale "), value))
        .when(F.col("event_type") == "click", F.concat(F.lit("# note\n\nresidual_keep = "), value, F.lit("\nping")))
        .when(F.col("event_type") == "view", F.lit("controls 1 0.5 0.5\nreset-controls\nresetcodec")).otherwise(F.concat(F.lit("set mv_scale much\n"), "props"))
    )
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("frame_no"), message.alias("message"))
    return controls.messages(rows, keys=("stream_id", "frame_no"))


def _signal(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("at"), F.col("value").alias("sample"), "event_type")


@query
def control_latest_sample(spark, sf_dir):
    rows = _signal(spark, sf_dir)
    ticks, samples = rows.filter("event_type = 'view'").select("user_id", "at"), rows.filter("event_type = 'click'")
    out = controls.latest(ticks, samples, ("user_id",))
    return out.select("user_id", "at", F.round(controls.mapped(1.0, F.col("sample") / 100, 0.5, 1.5, 0.1), 6).alias("control"))


@query
def reset_hysteresis(spark, sf_dir):
    rows = _signal(spark, sf_dir).groupBy("user_id", "at").agg(F.max("sample").alias("sample"))
    return controls.resets(rows, ("user_id",), "sample", 60.0, 20.0).select("user_id", "at", "fires")


@query
def preset_catalogue(spark, sf_dir):
    return params.preset_table(spark)


@query
def parameter_catalogue(spark, sf_dir):
    return params.parameter_table(spark)


# Folds over streams: no SQL expresses them; their tests hold known bytes, round trips and bounds


def _codec_query(backend, preset):
    def run(spark, sf_dir):
        ship_package(spark)
        packed = frames.assemble_frames(footage(spark, sf_dir)).withColumn("frame_no", F.col("frame_no").cast("long"))
        out = Engine(backend, W, H).set_preset(preset).process(packed)
        return out.select("stream_id", "frame_no", F.sha2("pixels", 256).alias("digest"), F.length("pixels").alias("bytes"))

    run.__name__ = f"codec_{backend}"
    QUERIES[run.__name__] = run


for _backend, _preset in (("motion", "melt"), ("scanline", "composite"), ("transform", "destroy"), ("wavelet", "hierarchy-collapse")):
    _codec_query(_backend, _preset)


@query
def codec_patterns(spark, sf_dir):
    """Every pattern of the second motion codec, a stream each."""
    from frameloom.operators.pattern_codec import PATTERNS, PatternCodec

    ship_package(spark)
    packed = frames.assemble_frames(footage(spark, sf_dir)).withColumn("frame_no", F.col("frame_no").cast("long"))
    outs = [fold_frames(packed, lambda name=name: PatternCodec(W, H, name), W, H).withColumn("pattern", F.lit(name)) for name in PATTERNS]
    whole = outs[0]
    for out in outs[1:]:
        whole = whole.unionByName(out)
    return whole.select("pattern", "stream_id", "frame_no", F.sha2("pixels", 256).alias("digest"))


def _chunks(spark, sf_dir):
    rows = _units(spark, sf_dir)
    code = F.when(F.col("kind") == "header", F.lit("0000000167")).when(F.col("kind") == "key", F.lit("00000165")).otherwise(F.lit("0000000141"))
    return rows.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").alias("chunk_no"), F.concat(F.unhex(code), "payload").alias("bytes"))


RULES = {"recover_every": 3, "drop_slice_every": 7, "splice_slice_every": 3, "xor_slice_every": 5, "echo_slice_every": 4, "truncate_slice_every": 6}


@query
def unit_filter_stream(spark, sf_dir):
    ship_package(spark)
    out = unit_filter.filter_streams(_chunks(spark, sf_dir), **RULES)
    return out.select("stream_id", "seq", F.sha2("data", 256).alias("digest"))


@query
def unit_filter_counters(spark, sf_dir):
    ship_package(spark)
    return unit_filter.stream_counters(_chunks(spark, sf_dir), **RULES)


@query
def stateful_stream_replay(spark, sf_dir):
    """The unit filter as a stream over files of chunks, run to the end of its input."""
    from uuid import uuid4

    from frameloom.streaming.units import filter_stream

    ship_package(spark)
    folder = f"{shared_folder(spark)}/replay-{uuid4().hex}"
    chunks = _chunks(spark, sf_dir)
    last = chunks.groupBy("stream_id").agg(F.max("chunk_no").alias("end"))
    chunks = chunks.join(last, "stream_id").withColumn("last", F.col("chunk_no") == F.col("end")).drop("end")
    chunks.repartition("stream_id").sortWithinPartitions("stream_id", "chunk_no").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(chunks.schema).parquet(f"{folder}/in")
    out = filter_stream(stream, **RULES)
    run = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").select("stream_id", "seq", F.sha2("data", 256).alias("digest"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_dct_energy(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.SQL.items() if k in QUERIES}
