"""The line-signal codec: payload coding, clean bounds, errors that end at a marker, every preset."""

import random
import struct

import numpy as np
import pytest

from frameloom.operators import scanline_codec as sc
from frameloom.plans import params as P
from frameloom.plans.engine import Engine


def frame(p, w=48, h=24):
    y, x = np.mgrid[:h, :w]
    return np.stack([(13 * x + 7 * p) & 255, (19 * y + 3 * p) & 255, (11 * (x + y) + 5 * p) & 255], axis=-1).astype(np.uint8)


def test_payload_codes():
    rng = random.Random(1)
    for n in (0, 1, 7, 300, 500):
        lines = np.array([[0] * n, [1] * n, [rng.choice((0, 0, 5, -128, 127)) for _ in range(n)]])
        if n:
            assert [sc.read_zeros(c, n).tolist() for c in sc.code_zeros(lines)] == lines.tolist()
    for n in (0, 1, 2, 40, 90, 200):
        lines = np.array([[rng.choice((0, 0, 0, 3, -4, 9, -128)) for _ in range(n)] for _ in range(60)]).reshape(60, n)
        coded = sc.code_colours(lines)
        assert [sc.read_colours(c, n) for c in coded] == lines.tolist()
    quiet = np.zeros((1, 40), int)
    quiet[0, 7] = 2
    assert len(sc.code_colours(quiet)[0]) < 40
    pair = np.array([-71, 15])
    assert all(tuple(sc.turned(*sc.turned(*pair, np.array(p)), np.array(-p))) == tuple(pair) for p in range(4))


def test_clean_bounds():
    flat = np.full((32, 64, 3), 96, np.uint8)
    assert np.abs(sc.ScanlineCodec(64, 32).process(flat).astype(int) - 96).max() <= 3
    textured = frame(9, 64, 32)
    assert np.abs(sc.ScanlineCodec(64, 32).process(textured).astype(int) - textured).mean() < 20


def test_an_error_ends_at_the_next_marker():
    clean, hurt = sc.ScanlineCodec(64, 48), sc.ScanlineCodec(64, 48)
    planes = sc.to_ycbcr(frame(2, 64, 48))
    signal = clean.encode(planes)
    found = sc.records_of(signal)
    lines = [(struct.unpack_from("<H", signal, r.head + 2)[0], signal[r.head + 4] > 127) for r in found]
    hit = next(i for i in range(2, len(found)) if not lines[i][1] and not lines[i + 1][1])
    bad = bytearray(signal)
    struct.pack_into("<h", bad, found[hit].head + 6, 9)
    a, b = clean.decode(signal), hurt.decode(bytes(bad))
    nxt = next(i for i in range(hit + 1, len(found)) if lines[i][1])
    assert (a[lines[hit][0]] != b[lines[hit][0]]).any() and (a[lines[hit + 1][0]] != b[lines[hit + 1][0]]).any()
    assert (a[lines[nxt][0]] == b[lines[nxt][0]]).all()


def test_presets_differ_and_are_clean_without_intensity():
    plain = sc.ScanlineCodec(48, 24)
    clean = [plain.process(frame(f)) for f in range(4)]
    outs = {}
    for name, *_ in P.PRESETS["scanline"]:
        codec = Engine("scanline", 48, 24).set_preset(name).codec()
        outs[name] = b"".join(codec.process(frame(f)).tobytes() for f in range(6))
        off = Engine("scanline", 48, 24).set_preset(name).set_controls(intensity=0.0).codec()
        assert all((off.process(frame(f)) == c).all() for f, c in enumerate(clean))
    assert len(set(outs.values())) >= 17


def test_bad_signals_and_settings():
    codec = sc.ScanlineCodec(48, 24)
    with pytest.raises(ValueError, match="signal"):
        codec.decode(b"SCN0")
    with pytest.raises(ValueError, match="power of two"):
        sc.ScanlineCodec(48, 24, chroma_group=3)
    lost = sc.ScanlineCodec(48, 24, sync_loss_every=2)
    lost.process(frame(0))
    assert lost.counts["concealed_lines"] > 0 and lost.counts["sync_loss"] == 12
