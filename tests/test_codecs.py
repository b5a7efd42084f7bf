"""The whole-frame codecs: round trips, bounds, resets, controls, and the entropy stage."""

from collections import Counter

import numpy as np
import pytest

from frameloom.operators import transform_codec as tc
from frameloom.operators.wavelet_codec import WaveletCodec, lift, unlift
from frameloom.plans import params as P
from frameloom.plans.engine import Engine


def ramp(w, h, f=0):
    y, x = np.mgrid[:h, :w]
    return np.stack([(17 * x + 13 * f) & 255, (23 * y + 7 * f) & 255, (19 * (x ^ y) + 29 * f) & 255], axis=-1).astype(np.uint8)


def gradient(w, h):
    y, x = np.mgrid[:h, :w]
    return np.stack([(3 * x) & 255, (5 * y + 20) & 255, (2 * (x + y) + 40) & 255], axis=-1).astype(np.uint8)


def test_wavelet_is_exact_at_full_quality():
    frame = ramp(17, 13)
    assert (WaveletCodec(17, 13, quality=100).process(frame) == frame).all()
    a = np.random.default_rng(1).integers(-500, 500, (7, 11))
    assert (unlift(lift(a, 1), 1) == a).all() and (unlift(lift(a, 0), 0) == a).all()


def test_wavelet_presets_differ_and_reset_is_fresh():
    seen = set()
    for name, _, _ in P.PRESETS["wavelet"]:
        codec = Engine("wavelet", 48, 32).set_preset(name).codec()
        outs = [codec.process(ramp(48, 32, f)) for f in range(8)]
        seen.add(b"".join(o.tobytes() for o in outs))
        codec.reset()
        assert [codec.process(ramp(48, 32, f)).tobytes() for f in range(8)] == [o.tobytes() for o in outs]
    assert len(seen) >= 9
    packet = WaveletCodec(32, 24).encode(ramp(32, 24))
    assert len(packet) == 30 and WaveletCodec(32, 24).estimated_bytes(packet) > 16 * 31


def test_transform_bounds_and_entropy_stage():
    for (w, h), q, most in (((80, 48), 95, 12.0), ((70, 37), 90, 14.0)):
        frame = gradient(w, h)
        clean = tc.TransformCodec(w, h, quality=q).process(frame)
        assert np.abs(clean.astype(int) - frame).mean() < most
        coded = tc.TransformCodec(w, h, quality=q, **{"bs.enabled": True}).process(frame)
        assert (coded == clean).all()


def test_entropy_round_trip_and_damage():
    rng = np.random.default_rng(2)
    planes = [rng.integers(-3, 4, s) * (rng.random(s) < 0.2) for s in ((3, 4, 64), (2, 2, 64), (2, 2, 64))]
    planes[0][0, 0, 0], planes[0][1, 1, 5], planes[1][0, 1, 63] = 32767, -32768, 900
    planes[2][0, 0] = 0
    planes = [p.astype(np.int16) for p in planes]
    data = tc.encode_stream(planes, 32, 24)
    back = tc.decode_stream(data, [p.shape for p in planes])
    assert all((a == b).all() for a, b in zip(planes, back))
    for p in ({"byte_flip_every": 3}, {"drop_every": 2}, {"slip_every": 1, "slip_bytes": 5, "slip_window": 16}, {"truncate_tail": 0.5}, {"truncate_tail": 1.0}):
        settings = {k[3:]: v for k, v in tc.TransformCodec.defaults.items() if k.startswith("bs.")} | p
        hurt = tc.mutate(data, settings, 7, Counter())
        out = tc.decode_stream(hurt, [q.shape for q in planes])
        assert [o.shape for o in out] == [q.shape for q in planes] and any((a != b).any() for a, b in zip(planes, out))
    bits, order = tc.code_lengths(Counter({i: 1 << i for i in range(40)}))
    assert len(bits) == 16 and sum(bits) == 40 == len(order)


@pytest.mark.parametrize("name", [p[0] for p in P.PRESETS["transform"]])
def test_transform_presets(name):
    frames = [ramp(48, 32, f) for f in range(3)]
    clean = [tc.TransformCodec(48, 32).process(f) for f in frames]
    codec = Engine("transform", 48, 32).set_preset(name).codec()
    outs = [codec.process(f) for f in frames]
    assert all((a == b).all() for a, b in zip(clean, outs)) == (name == "clean")
    off = Engine("transform", 48, 32).set_preset(name).set_controls(intensity=0.0).codec()
    assert all((off.process(f) == c).all() for f, c in zip(frames, clean))


def test_controls():
    at = P.under_controls("motion", P.preset("motion", "melt"), P.Controls(intensity=2.0))
    assert at["reference_lag"] == 15 and at["mv_jitter"] == 2
    for backend in ("motion", "transform", "wavelet"):
        for name, *_ in P.PRESETS[backend]:
            p = P.preset(backend, name)
            same = P.under_controls(backend, p, P.Controls())
            assert {k: v for k, v in same.items() if k != "bs.enabled"} == pytest.approx({k: v for k, v in p.items() if k != "bs.enabled"})
    assert P.Controls(intensity=float("nan")).amount("motion") == 0 and P.Controls(5, 5).amount("motion") == 4
    assert P.with_parameter("wavelet", P.preset("wavelet", "clean"), "packet_shift_every", -3)["packet_shift_every"] == 0
    with pytest.raises(ValueError, match="no preset"):
        P.preset("motion", "nonsense")
    assert P.preset("motion", "pixel-melt") == P.preset("motion", "pixel")


def test_setters():
    m = P.preset("motion", "clean")
    m = P.with_parameter("motion", m, "mv_scale", 9)
    assert m["mv_scale_x"] == m["mv_scale_y"] == 2.0 and not m["bs.enabled"]
    m = P.with_parameter("motion", m, "entropy_slip_every", 2.5)
    assert m["bs.entropy_slip_every"] == 3 and m["bs.enabled"]
    assert P.with_parameter("motion", m, "bitstream_enabled", 0)["bs.enabled"] is False
    assert P.with_parameter("motion", m, "block_size", 1)["cfg.block_size"] == 4
    s = P.preset("scanline", "clean")
    shifted = P.with_parameter("scanline", s, "mv_scale", 1.25)
    assert shifted["line_shift"] == 8 and shifted["line_shift_every"] == 1
    assert P.with_parameter("scanline", s, "mv_scale", 1.0)["line_shift_every"] == 0
    woven = P.with_parameter("scanline", s, "reference_bleed", 0.5)
    assert woven["history_line_weave"] == 4 and woven["history_line_weave_every"] == 3
    assert P.with_parameter("scanline", s, "quant_offset", 500)["quant_offset"] == 64
    with pytest.raises(ValueError, match="no parameter"):
        P.with_parameter("scanline", s, "nonsense", 1)


def test_engine_on_streams(spark):
    rows = [(f"s{s}", f, bytes(np.dstack([ramp(32, 24, f + s), np.full((24, 32), 7, np.uint8)]).tobytes()), s == 1 and f == 3) for s in range(3) for f in range(6)]
    frames = spark.createDataFrame(rows, "stream_id string, frame_no long, pixels binary, reset boolean").repartition(4)
    engine = Engine(4, 32, 24).set_preset("hierarchy-collapse")
    out = {(r.stream_id, r.frame_no): np.frombuffer(bytes(r.pixels), np.uint8).reshape(24, 32, 4) for r in engine.process(frames).collect()}
    for s in range(3):
        codec = engine.codec()
        for f in range(6):
            if s == 1 and f == 3:
                codec.reset()
            assert (out[f"s{s}", f][..., :3] == codec.process(ramp(32, 24, f + s))).all() and (out[f"s{s}", f][..., 3] == 7).all()
    stats = {(r.stream_id, r.counter): r.value for r in engine.stats(frames).collect()}
    assert stats["s0", "frames_in"] == 6 and stats["s0", "keyframes"] == 6 and stats["s0", "blocks_encoded"] == 6 * 30
    assert P.preset_table(spark).count() > 100 and P.parameter_table(spark).count() > 100
