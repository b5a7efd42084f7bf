"""Frame codecs as streams: equal to the batch form, late frames dropped, restart from a checkpoint, controls by frame."""

import numpy as np
import pytest

from frameloom.plans.engine import Engine
from frameloom.streaming.frames import process_stream

W, H = 32, 24
SCHEMA = "stream_id string, frame_no long, pixels binary, reset boolean, intensity double"


def frame(f):
    y, x = np.mgrid[:H, :W]
    return np.stack([(5 * x + 11 * f) & 255, (9 * y + 7 * f) & 255, (13 * (x ^ y) + 17 * f) & 255], axis=-1).astype(np.uint8)


@pytest.mark.parametrize(("backend", "preset"), [("motion", "melt"), ("scanline", "composite"), ("transform", "flow"), ("wavelet", "temporal-weave")])
def test_stream_equals_batch(spark, tmp_path, backend, preset):
    engine = Engine(backend, W, H).set_preset(preset)
    rows = [(f"s{s}", f, frame(f + s).tobytes(), s == 1 and f == 4, None if f % 3 else 0.5) for s in range(2) for f in range(7)]
    batch = {(r.stream_id, r.frame_no): bytes(r.pixels) for r in engine.process(spark.createDataFrame(rows, SCHEMA)).collect()}
    name = f"frames_{backend}"

    def deliver(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        q = process_stream(stream, engine).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).queryName(name).start()
        q.awaitTermination()

    deliver([r for r in rows if r[1] < 4])
    deliver([r for r in rows if r[1] >= 3])  # frame 3 again: a late one
    got = [((r.stream_id, r.frame_no), bytes(r.pixels)) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(batch) and dict(got) == batch


def test_controls_by_frame_follow(spark):
    engine = Engine("wavelet", W, H).set_preset("hierarchy-collapse")
    rows = [("s", f, frame(f).tobytes(), False, 0.0 if f < 3 else 1.0) for f in range(6)]
    out = {r.frame_no: bytes(r.pixels) for r in engine.process(spark.createDataFrame(rows, SCHEMA)).collect()}
    clean = Engine("wavelet", W, H).codec()
    same = [clean.process(frame(f)).tobytes() == out[f] for f in range(6)]
    assert all(same[:3]) and not any(same[3:])
