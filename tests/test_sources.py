"""Raw files, the command line, and column classification against the kernel."""

import random

import numpy as np
import pytest

from frameloom.__main__ import main
from frameloom.operators import unit_columns
from frameloom.operators.unit_filter import classify, run_units
from frameloom.sources import frames


def test_raw_frames(spark, tmp_path):
    data = np.random.default_rng(1).integers(0, 256, 5 * 6 * 4 * 3, dtype=np.uint8).tobytes()
    (tmp_path / "a.rgb").write_bytes(data)
    rows = sorted(frames.raw_frames(spark, str(tmp_path / "a.rgb"), 6, 4).collect(), key=lambda r: r.frame_no)
    assert b"".join(bytes(r.pixels) for r in rows) == data and len(rows) == 5
    (tmp_path / "b.rgb").write_bytes(data[:-1])
    assert frames.raw_frames(spark, str(tmp_path / "b.rgb"), 6, 4, strict=False).count() == 4
    with pytest.raises(Exception, match="inside a frame"):
        frames.raw_frames(spark, str(tmp_path / "b.rgb"), 6, 4).collect()


def test_command_line(spark, tmp_path, capsys):
    rng = random.Random(1)
    data = b"".join(bytes.fromhex("0000000141") + rng.randbytes(5) for _ in range(20))
    (tmp_path / "in.h264").write_bytes(data)
    assert main(["filter", "--drop-slice-every=3", "--codec", "AVC", str(tmp_path / "in.h264"), str(tmp_path / "out")], spark) == 0
    got = [bytes(r.data) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()]
    assert got == run_units([data], drop_slice_every=3)[0]
    (tmp_path / "v.rgb").write_bytes(bytes(32 * 24 * 3 * 2))
    args = ["frames", "--backend", "wavelet", "--width", "32", "--height", "24", "--set", "packet_shift_every=2", str(tmp_path / "v.rgb"), str(tmp_path / "frames")]
    assert main(args, spark) == 0 and spark.read.parquet(str(tmp_path / "frames")).count() == 2
    assert main([*args[:-2], str(tmp_path / "none"), str(tmp_path / "frames")], spark) == 1
    assert main(["filter", "--codec", "vp9", "a", "b"]) == 2 and main(["presets"]) == 0
    assert "melt" in capsys.readouterr().out


@pytest.mark.parametrize("codec", ["h264", "hevc", "mpeg4", "mpeg1", "mpeg2"])
def test_classification(spark, codec):
    rng = random.Random(2)
    code = lambda: rng.choice((0, 0, rng.randrange(256), 0xB6, 0xB5, 0xB3, 0x21, 1, 0x41, 0x65, 0x67, 0x26, 0x40))
    rows = [("s", i, bytes.fromhex(rng.choice(("000001", "00000001", "0001"))) + bytes([code()]) + rng.randbytes(rng.randint(0, 4))) for i in range(400)]
    out = unit_columns.classified(spark.createDataFrame(rows, "stream_id string, seq long, data binary"), codec).collect()
    current, want = "", {}
    for _, i, data in rows:
        u = classify(codec, data, current)
        current = u.picture if u.role == "picture" else current
        want[i] = (u.role, u.picture or None)
    assert {r.seq: (r.role, r.picture) for r in out} == want
