"""The frame codecs against models that go sample by sample, for every preset, three sizes and six frames."""

import numpy as np
import pytest

from frameloom.plans import params as P
from frameloom.plans.engine import Engine
from models import motion, scanline, transform, wavelet

SIZES = ((48, 32), (33, 17), (21, 26))
NAMES = {b: [p[0] for p in P.PRESETS[b]] for b in P.PRESETS}


def footage(w, h, n=6):
    """A pattern that drifts, with a box that jumps over it."""
    y, x = np.mgrid[:h, :w]
    out = []
    for f in range(n):
        frame = np.stack([(5 * x + 11 * f) & 255, (9 * y + 7 * f) & 255, (13 * (x ^ y) + 17 * f) & 255], axis=-1).astype(np.uint8)
        frame[(5 * f) % h : (5 * f) % h + 8, (7 * f) % w : (7 * f) % w + 9] = (240, 30 + f, 200)
        out.append(frame)
    return out


def check(model, backend, name, tune=None):
    for w, h in SIZES:
        codec = Engine(backend, w, h).set_preset(name).codec()
        if tune:
            codec.tune(tune(codec.params))
        frames = footage(w, h)
        want = model([f.tolist() for f in frames], w, h, dict(codec.params))
        for i, f in enumerate(frames):
            assert codec.process(f).tolist() == [[list(p) for p in row] for row in want[i]], (name, w, h, i)


@pytest.mark.parametrize("name", NAMES["wavelet"])
def test_wavelet(name):
    check(wavelet.run, "wavelet", name)


@pytest.mark.parametrize("name", NAMES["transform"])
def test_transform(name):
    check(transform.run, "transform", name)


@pytest.mark.parametrize("name", NAMES["transform"][::4])
def test_transform_with_damaged_bytes(name):
    check(transform.run, "transform", name, lambda p: p | {"bs.enabled": True, "bs.byte_flip_every": 97, "bs.slip_every": 3, "bs.slip_bytes": 2, "bs.slip_window": 32, "bs.truncate_tail": 0.1})


@pytest.mark.parametrize("name", NAMES["scanline"])
def test_scanline(name):
    for w, h in SIZES:
        codec = Engine("scanline", w, h).set_preset(name).codec()
        model = scanline.LineByLine(w, h, codec.quant, codec.group, codec.depth, **codec.p)
        for f in footage(w, h):
            assert (codec.process(f) == model.process(f)).all()
        assert codec.counts["encoded_bytes"] == model.counts["encoded_bytes"]


@pytest.mark.parametrize("name", NAMES["motion"])
def test_motion(name):
    for (w, h), settings in zip(SIZES, ({}, {"block_size": 8}, {"block_size": 8, "keyframe_interval": 4})):
        codec = Engine("motion", w, h, **settings).set_preset(name).codec()
        own = {k: getattr(codec, a) for k, a in (("block_size", "size"), ("search_radius", "radius"), ("search_step", "step"), ("keyframe_interval", "interval"), ("history_len", "depth"), ("feedback", "feedback"))}
        model = motion.SampleBySample(w, h, **own, **codec.p, **{f"bs.{k}": v for k, v in codec.bs.items()})
        for i, f in enumerate(footage(w, h)):
            assert (codec.process(f) == model.process(f)).all(), (name, w, h, i)
