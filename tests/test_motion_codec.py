"""The block-motion codec: identities, feedback, every preset, packet bytes."""

import numpy as np
import pytest

from frameloom.operators.motion_codec import MotionCodec, Packet
from frameloom.plans import params as P
from frameloom.plans.engine import Engine


def frame(f, w=48, h=24):
    y, x = np.mgrid[:h, :w]
    return np.stack([(5 * x + 11 * f) & 255, (9 * y + 7 * f) & 255, (13 * (x ^ y) + 17 * f) & 255], axis=-1).astype(np.uint8)


def test_prediction_rebuilds_the_frame():
    a = np.zeros((2, 4, 3), np.uint8)
    a[..., 0] = np.arange(0, 80, 10).reshape(2, 4)
    b = a.copy()
    b[..., 0] += 10
    codec = MotionCodec(4, 2, block_size=2, search_radius=2, search_step=1, history_len=4)
    assert (codec.process(a) == a).all() and (codec.process(b) == b).all()
    assert codec.counts["keyframes"] == 1 and codec.counts["predicted"] == 1


def test_clean_preset_and_keyframes():
    codec = MotionCodec(48, 24, keyframe_interval=3)
    assert all((codec.process(frame(f)) == frame(f)).all() for f in range(7)) and codec.counts["keyframes"] == 3


def test_presets_differ_and_are_clean_without_intensity():
    outs = {}
    for name, *_ in P.PRESETS["motion"]:
        codec = Engine("motion", 48, 24).set_preset(name).codec()
        outs[name] = b"".join(codec.process(frame(f)).tobytes() for f in range(4))
        again = Engine("motion", 48, 24).set_preset(name).codec()
        assert b"".join(again.process(frame(f)).tobytes() for f in range(4)) == outs[name]
    assert len(set(outs.values())) >= 17
    off = Engine("motion", 48, 24).set_preset("entropy-hard").set_controls(intensity=0.0).codec()
    assert all((off.process(frame(f)) == frame(f)).all() for f in range(4))


def test_packet_bytes():
    codec = MotionCodec(48, 24)
    codec.process(frame(0))
    packet = codec.encode(frame(1))
    data = packet.to_bytes()
    back = Packet.from_bytes(data + b"more")
    assert (back.blocks == packet.blocks).all() and (back.residual == packet.residual).all()
    assert len(data) == 28 + 12 * 6 + 2 * 48 * 24 * 3 and data[:8] == b"MSH0\1\1\0\0"
    for bad in (b"", b"XXXX" + data[4:], data[:40]):
        with pytest.raises(ValueError, match="packet"):
            Packet.from_bytes(bad)


@pytest.mark.parametrize("bs", [{"mv_sign_flip_every": 2}, {"mv_delta_every": 1, "mv_delta_x": 40}, {"block_address_shift_every": 2, "block_address_shift_x": 5}, {"residual_zero_every": 1}, {"residual_xor_every": 2}, {"entropy_slip_every": 1, "entropy_slip_bytes": 1}, {"coeff_glitch_every": 1, "coeff_zero_high": 2}, {"codebook_replace_every": 1}])
def test_damage_is_counted_and_shows(bs):
    codec = MotionCodec(48, 24, **{f"bs.{k}": v for k, v in bs.items()})
    outs = [codec.process(frame(f)) for f in range(4)]
    assert any((o != frame(f)).any() for f, o in enumerate(outs))
    assert sum(v for k, v in codec.counts.items() if k not in ("frames_in", "keyframes", "predicted", "blocks_encoded")) > 0


def test_reset_starts_with_a_keyframe():
    codec = Engine("motion", 48, 24).set_preset("melt").codec()
    [codec.process(frame(f)) for f in range(3)]
    codec.reset()
    assert (codec.process(frame(3)) == frame(3)).all() and codec.counts["frames_in"] == 4
