"""Parameters of the codecs: defaults, presets, macro controls, setters. All of it runs on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from frameloom.plans import presets as fixed

MAX_CONTROL, MAX_COMBINED = 2.0, 4.0


@dataclass(frozen=True)
class Controls:
    """Macro controls; anything that is not finite counts as 0, and each is held to 0…2."""

    intensity: float = 1.0
    motion: float = 1.0
    residual: float = 1.0
    temporal: float = 1.0
    bitstream: float = 1.0

    def amount(self, channel: str) -> float:
        held = [min(max(v, 0.0), MAX_CONTROL) if math.isfinite(v) else 0.0 for v in (self.intensity, getattr(self, channel))]
        return min(held[0] * held[1], MAX_COMBINED)


def rounded(v: float) -> int:
    return int(math.copysign(math.floor(abs(v) + 0.5), v))


def _held(bits: int):
    low, high = -(1 << bits - 1), (1 << bits - 1) - 1
    return lambda v, a: max(low, min(high, rounded(v * a)))


#: How a parameter follows its control's amount.
SCALES = {
    "i8": _held(8), "i16": _held(16), "i32": _held(32),
    "size": lambda v, a: max(0, rounded(v * a)),
    "u8": lambda v, a: max(0, min(255, rounded(v * a))),
    "period": lambda v, a: 0 if v == 0 or a <= 0 else max(1, rounded(v / a)),
    "factor": lambda v, a: 1.0 + (v - 1.0) * a,
    "factor_up": lambda v, a: max(1.0, 1.0 + (v - 1.0) * a),
    "plain": lambda v, a: v * a,
    "share": lambda v, a: min(max(v * a, 0.0), 0.98),
    "part": lambda v, a: min(max(v * a, 0.0), 1.0),
    "after_one": lambda v, a: 1 + max(0, rounded((v - 1) * a)),
    "cutoff": lambda v, a: 0 if v == 0 or a <= 0 else max(1, min(63, rounded(63 + (v - 63) * a))),
    "switch": lambda v, a: v and a > 0,
}

#: For each backend: control, kind of scaling, parameters.
CONTROLLED = {
    "motion": (
        ("motion", "factor", "mv_scale_x mv_scale_y"),
        ("motion", "i16", "mv_jitter channel_shift mv_predictor_desync_x mv_predictor_desync_y"),
        ("motion", "i32", "block_remap_stride mv_bank_stride"),
        ("motion", "period", "block_remap_every mv_predictor_desync_every mv_bank_shuffle_every"),
        ("motion", "plain", "motion_diffusion mv_field_interpolation sample_address_desync"),
        ("residual", "factor", "residual_keep"),
        ("residual", "period", "residual_invert_every residual_bank_shuffle_every"),
        ("residual", "i16", "residual_address_shift_x residual_address_shift_y residual_address_jitter residual_channel_shift"),
        ("residual", "i32", "residual_bank_stride"),
        ("temporal", "after_one", "reference_lag reference_latch_frames reference_slot_count"),
        ("temporal", "plain", "reference_bleed"),
        ("temporal", "period", "reference_slot_shuffle_every"),
        ("temporal", "size", "reference_scanline_lag_span temporal_slice_lag_span reference_channel_lag_span"),
        ("temporal", "i16", "temporal_slice_drift reference_channel_lag_stride"),
        ("bitstream", "period", "bs.mv_sign_flip_every bs.mv_delta_every bs.block_address_shift_every bs.residual_zero_every bs.residual_xor_every bs.entropy_slip_every bs.coeff_glitch_every bs.coeff_sign_flip_every bs.codebook_replace_every bs.codebook_shuffle_every"),
        ("bitstream", "i16", "bs.mv_delta_x bs.mv_delta_y bs.block_address_shift_x bs.block_address_shift_y bs.entropy_slip_bytes bs.coeff_shift"),
        ("bitstream", "size", "bs.entropy_slip_windows"),
        ("bitstream", "after_one", "bs.coeff_quant"),
        ("bitstream", "i32", "bs.codebook_stride"),
    ),
    "scanline": (
        ("motion", "i16", "line_shift line_shift_drift line_index_offset line_index_stride"),
        ("motion", "period", "line_shift_every line_index_every"),
        ("residual", "i8", "quant_offset chroma_group_delta phase_offset phase_drift chroma_sequence_offset"),
        ("residual", "period", "quant_offset_every carrier_sign_flip_every burst_loss_every chroma_sequence_every chroma_seed_loss_every chroma_xor_every chroma_payload_slip_every"),
        ("residual", "u8", "chroma_xor_mask"),
        ("residual", "i16", "chroma_payload_slip"),
        ("temporal", "after_one", "predictor_lag"),
        ("temporal", "period", "predictor_flip_every predictor_line_offset_every history_line_weave_every"),
        ("temporal", "i16", "predictor_line_offset"),
        ("temporal", "size", "history_line_weave"),
        ("bitstream", "period", "sync_loss_every field_sync_loss_every field_parity_flip_every luma_payload_slip_every luma_run_delta_every packet_length_delta_every payload_swap_every"),
        ("bitstream", "i16", "luma_payload_slip packet_length_delta"),
        ("bitstream", "i8", "luma_run_delta"),
    ),
    "transform": (
        ("bitstream", "factor_up", "quant_scale"),
        ("bitstream", "cutoff", "ac_zero_above"),
        ("temporal", "i16", "dc_drift dc_block_offset"),
        ("temporal", "period", "dc_drift_every dc_block_offset_every"),
        ("motion", "i16", "coeff_shift block_shift_x block_shift_y"),
        ("motion", "period", "coeff_sign_flip_every coeff_shift_every block_shift_every block_repeat_every zigzag_reverse_every block_transpose_every chroma_swap_every"),
        ("residual", "share", "persistence"),
        ("bitstream", "period", "bs.byte_flip_every bs.drop_every bs.slip_every"),
        ("bitstream", "i32", "bs.slip_bytes"),
        ("bitstream", "part", "bs.truncate_tail"),
        ("bitstream", "switch", "bs.enabled"),
    ),
    "wavelet": (
        ("motion", "i16", "packet_shift"),
        ("motion", "i8", "orientation_rotate level_fold"),
        ("motion", "period", "packet_shift_every orientation_rotate_every level_fold_every"),
        ("residual", "u8", "bitplane_clear bitplane_xor"),
        ("residual", "period", "bitplane_clear_every bitplane_xor_every sign_flip_every lifting_bias_every"),
        ("residual", "i16", "lifting_bias"),
        ("temporal", "after_one", "history_lag"),
        ("temporal", "period", "history_band_every"),
        ("temporal", "size", "lowpass_history_lag"),
        ("bitstream", "i8", "channel_route"),
        ("bitstream", "period", "channel_route_every packet_loss_every"),
    ),
}

DEFAULTS = {
    "motion": {**fixed.MOTION_DEFAULTS, **{f"bs.{k}": v for k, v in fixed.BITSTREAM_DEFAULTS.items()}},
    "scanline": fixed.SCANLINE_DEFAULTS,
    "transform": {**fixed.TRANSFORM_DEFAULTS, **{f"bs.{k}": v for k, v in fixed.ENTROPY_DEFAULTS.items()}},
    "wavelet": fixed.WAVELET_DEFAULTS,
}
PRESETS = {"motion": fixed.MOTION_PRESETS, "scanline": fixed.SCANLINE_PRESETS, "transform": fixed.TRANSFORM_PRESETS, "wavelet": fixed.WAVELET_PRESETS}


def preset(backend: str, name: str) -> dict:
    """All parameters of a backend under a preset, given by its name or another of its names; cfg.* are codec settings."""
    found = [(own, values) for own, others, values in PRESETS[backend] if name.lower() in (own, *others)]
    if not found:
        raise ValueError(f"no preset {name!r}; there are {', '.join(p[0] for p in PRESETS[backend])}")
    own, values = found[0]
    if backend == "transform":
        values = {**values, **{f"bs.{k}": v for n, _, more in fixed.ENTROPY_PRESETS if n == own for k, v in more.items()}}
    return {**DEFAULTS[backend], **values}


def under_controls(backend: str, params: dict, controls: Controls) -> dict:
    """Parameters as the macro controls scale them; all controls at 1 change nothing."""
    out = dict(params)
    for channel, kind, names in CONTROLLED.get(backend, ()):
        a = controls.amount(channel)
        for name in names.split():
            out[name] = SCALES[kind](out[name], a)
    if backend == "motion":
        if controls.amount("bitstream") <= 0:
            out.update({f"bs.{k}": v for k, v in fixed.BITSTREAM_DEFAULTS.items()})
        else:
            out["bs.enabled"] = has_mutations({k[3:]: v for k, v in out.items() if k.startswith("bs.")})
    return out


#: A mutation of the packet's bytes is live if its period is and one of its amounts is.
LIVE = (("mv_sign_flip_every",), ("mv_delta_every", "mv_delta_x", "mv_delta_y"), ("block_address_shift_every", "block_address_shift_x", "block_address_shift_y"), ("residual_zero_every",), ("residual_xor_every",), ("entropy_slip_every", "entropy_slip_bytes"), ("coeff_glitch_every",), ("codebook_replace_every",))


def has_mutations(bitstream: dict) -> bool:
    return any(bitstream[p] and (not amounts or any(bitstream[a] for a in amounts)) for p, *amounts in LIVE)


#: The ranges of the motion codec's setters; of cfg.* the codec is rebuilt.
MOTION_RANGES = {
    "mv_scale": (0.0, 2.0), "mv_jitter": (0, 16), "mv_field_interpolation": (0.0, 1.0), "sample_address_desync": (0.0, 4.0),
    "mv_bank_stride": (-64, 64), "reference_lag": (1, 32), "reference_bleed": (0.0, 1.0), "reference_latch_frames": (1, 64),
    "temporal_slice_drift": (-16, 16), "reference_channel_lag_span": (0, 32), "residual_keep": (-2.0, 2.0), "residual_address_jitter": (0, 32),
    "residual_channel_shift": (-4, 4), "residual_bank_stride": (-64, 64), "entropy_slip_every": (0, 64), "entropy_slip_windows": (0, 64),
    "entropy_resync_bytes": (0, 65536), "coeff_shift": (-32, 32), "coeff_quant": (1, 64), "codebook_replace_every": (0, 64),
    "codebook_stride": (-128, 128), "codebook_shuffle_every": (0, 64), "block_size": (4, 64), "search_radius": (0, 64), "search_step": (1, 16),
}
#: The ranges of the line codec's amounts; periods go from 0 to 512.
SCANLINE_RANGES = {
    "line_shift": (-256, 256), "line_shift_drift": (-256, 256), "line_index_offset": (-256, 256), "line_index_stride": (-64, 64),
    "phase_offset": (-16, 16), "phase_drift": (-16, 16), "predictor_lag": (1, 64), "predictor_line_offset": (-256, 256),
    "quant_offset": (-64, 64), "luma_payload_slip": (-256, 256), "chroma_payload_slip": (-256, 256), "chroma_group_delta": (-6, 6),
    "chroma_sequence_offset": (-4, 4), "chroma_xor_mask": (0, 255), "luma_run_delta": (-127, 127), "packet_length_delta": (-1024, 1024),
    "history_line_weave": (0, 64),
}
#: The period that an amount of the line codec arms when it is off.
ARMS = {
    "line_shift": "line_shift_every", "line_shift_drift": "line_shift_every", "line_index_offset": "line_index_every", "line_index_stride": "line_index_every",
    "predictor_line_offset": "predictor_line_offset_every", "quant_offset": "quant_offset_every", "luma_payload_slip": "luma_payload_slip_every",
    "chroma_payload_slip": "chroma_payload_slip_every", "chroma_sequence_offset": "chroma_sequence_every", "luma_run_delta": "luma_run_delta_every",
    "packet_length_delta": "packet_length_delta_every", "history_line_weave": "history_line_weave_every",
}
#: Parameters of the motion codec that steer the line codec: what they set, how the value is made, and the period they
#: set: "off" arms it if it was off, a number sets it, None leaves it.
ALIASES = {
    "mv_jitter": ("line_shift", None, "off"), "temporal_slice_drift": ("line_index_offset", None, "off"), "codebook_shuffle_every": ("line_index_every", None, None),
    "residual_channel_shift": ("phase_offset", None, None), "mv_field_interpolation": ("phase_drift", None, None), "reference_lag": ("predictor_lag", None, None),
    "coeff_shift": ("quant_offset", None, "off"), "sample_address_desync": ("luma_payload_slip", None, "off"), "residual_address_jitter": ("luma_payload_slip", None, "off"),
    "entropy_slip_every": ("luma_payload_slip_every", None, None), "codebook_stride": ("history_line_weave", abs, "live"), "codebook_replace_every": ("history_line_weave_every", None, None),
    "mv_scale": ("line_shift", lambda v: (v - 1) * 32, "live"), "reference_bleed": ("history_line_weave", lambda v: min(max(v, 0.0), 1.0) * 8, 3),
    "reference_latch_frames": ("history_line_weave", None, 1), "residual_keep": ("quant_offset", lambda v: (v - 1) * 8, 1),
    "entropy_slip_windows": ("luma_payload_slip", None, None), "coeff_quant": ("quant_offset", None, 1),
}


def _fitted(value: float, low, high):
    held = min(max(value, low), high)
    return held if isinstance(low, float) else min(max(rounded(value), low), high)


def _with_motion(params: dict, name: str, value: float) -> dict:
    if name == "bitstream_enabled":
        return {**params, "bs.enabled": value >= 0.5}
    fitted = _fitted(value, *MOTION_RANGES[name])
    if name == "mv_scale":
        out = {**params, "mv_scale_x": fitted, "mv_scale_y": fitted}
    else:
        key = f"cfg.{name}" if name in ("block_size", "search_radius", "search_step") else name if name in params else f"bs.{name}"
        out = {**params, key: fitted}
    live = has_mutations({k[3:]: v for k, v in out.items() if k.startswith("bs.")})
    return {**out, "bs.enabled": out["bs.enabled"] or live}


def _with_scanline(params: dict, name: str, value: float) -> dict:
    own = name in params
    target, make, arm = (name, abs if name == "history_line_weave" else None, "live" if name == "history_line_weave" else "off") if own else ALIASES[name]
    value = make(value) if make else value
    if target.endswith("_every"):
        return {**params, target: min(max(rounded(value), 0), 512)}
    fitted = _fitted(value, *SCANLINE_RANGES[target])
    out = {**params, target: fitted}
    period = ARMS.get(target)
    if period and arm is not None:
        if isinstance(arm, int):
            out[period] = arm
        elif out[period] == 0 and (arm == "off" or fitted):
            out[period] = 1
    return out


def with_parameter(backend: str, params: dict, name: str, value: float) -> dict:
    """One parameter set, held to its range and rounded; a value that is not finite counts as 0.

    The motion codec's named setters have ranges and switch the bitstream on when a mutation is live. The line codec
    also takes names of the motion codec, and an amount arms its period. Other parameters take their default's type.
    """
    value = value if math.isfinite(value) else 0.0
    if backend == "motion" and (name in MOTION_RANGES or name == "bitstream_enabled"):
        return _with_motion(params, name, value)
    if backend == "scanline" and (name in params or name in ALIASES):
        return _with_scanline(params, name, value)
    known = name if name in params else f"bs.{name}"
    if known not in params:
        raise ValueError(f"no parameter {name!r}; there are {', '.join(params)}")
    default = DEFAULTS[backend].get(known, params[known])
    if isinstance(default, bool):
        made = value >= 0.5
    elif isinstance(default, int):
        made = max(0, rounded(value)) if known.endswith("_every") else rounded(value)
    else:
        made = float(value)
    return {**params, known: made}


def preset_table(spark: SparkSession) -> DataFrame:
    """(backend, preset, others, parameter, value): a row for each value that differs from its default."""
    rows = [(b, name, ",".join(others), k, str(v)) for b, ps in PRESETS.items() for name, others, values in ps for k, v in (values or {"": ""}).items()]
    return spark.createDataFrame(rows, "backend string, preset string, others string, parameter string, value string")


def parameter_table(spark: SparkSession) -> DataFrame:
    """(backend, parameter, kind, default, control): every parameter and the macro control that scales it."""
    by = {(b, n): c for b, rows in CONTROLLED.items() for c, _, names in rows for n in names.split()}
    rows = [(b, k, type(v).__name__, str(v), by.get((b, k))) for b, ps in DEFAULTS.items() for k, v in ps.items()]
    return spark.createDataFrame(rows, "backend string, parameter string, kind string, default string, control string")


