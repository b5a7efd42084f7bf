"""The second motion codec: its clean pattern, that patterns and overrides differ, resets."""

import numpy as np
import pytest

from frameloom.operators.pattern_codec import OVERRIDES, PATTERNS, VECTOR_DECODE, PatternCodec


def frame(f, w=96, h=64):
    y, x = np.mgrid[:h, :w]
    base = np.stack([(3 * x + y + 11 * f) & 255, (x + 2 * y + 17 * f) & 255, (2 * x + 3 * y + 5 * f) & 255], axis=-1).astype(np.uint8)
    base[5 * f % (h - 22) :, 7 * f % (w - 28) :][:22, :28] = (245, 35 + (13 * f & 63), 210)
    return base


def run(pattern, frames=12, **kw):
    codec = PatternCodec(96, 64, pattern, **kw)
    return codec, [codec.process(frame(f)) for f in range(frames)]


def test_clean_gives_the_input():
    assert all((o == frame(f)).all() for f, o in enumerate(run("clean")[1]))


def test_patterns_differ_and_reset_is_fresh():
    seen = {}
    for name in PATTERNS:
        codec, outs = run(name)
        seen[b"".join(o.tobytes() for o in outs)] = name
        codec.reset()
        assert all((codec.process(frame(f)) == o).all() for f, o in enumerate(outs[:6]))
    assert len(seen) == 13


@pytest.mark.parametrize("kind", VECTOR_DECODE[1:])
def test_vector_decoding_stays_clean_without_damage(kind):
    assert all((o == frame(f)).all() for f, o in enumerate(run("clean", 5, vector_decode=kind)[1]))
    assert any((a != b).any() for a, b in zip(run("melt", 6, vector_decode=kind)[1], run("clean", 6)[1]))


@pytest.mark.parametrize(("name", "value"), [("mv_scale", 3.0), ("mv_jitter", 3), ("vector_interpolation", 0.9), ("sample_address_desync", 3.0), ("reference_lag", 3), ("reference_bleed", 0.5), ("temporal_slice_drift", 2), ("residual_keep", 0.2), ("residual_address_jitter", 4), ("residual_channel_shift", 1), ("entropy_slip_every", 2), ("coeff_shift", 1), ("coeff_quant", 9), ("codebook_replace_every", 2)])
def test_overrides_show(name, value):
    assert name in OVERRIDES
    assert any((a != b).any() for a, b in zip(run("melt", 6, **{name: value})[1], run("melt", 6)[1]))


def test_bad_settings():
    with pytest.raises(ValueError, match="slots"):
        PatternCodec(8, 8, slots=1)
    with pytest.raises(ValueError, match="overrides"):
        PatternCodec(8, 8, nonsense=1)
