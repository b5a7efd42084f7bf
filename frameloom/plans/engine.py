"""The facade: a backend with a preset, controls and parameters, applied to streams of frames."""

from __future__ import annotations

from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from frameloom.operators.motion_codec import MotionCodec
from frameloom.operators.scanline_codec import ScanlineCodec
from frameloom.operators.transform_codec import TransformCodec
from frameloom.operators.wavelet_codec import WaveletCodec
from frameloom.plans import params as P

CODECS = {"motion": MotionCodec, "scanline": ScanlineCodec, "transform": TransformCodec, "wavelet": WaveletCodec}
BACKENDS = {1: "motion", 2: "scanline", 3: "transform", 4: "wavelet"}


class Engine:
    """``process`` folds each stream's frames in order; state is per stream and starts anew at a row with ``reset``."""

    def __init__(self, backend: str | int, width: int, height: int, **config):
        self.backend = BACKENDS.get(backend, backend)
        if self.backend not in CODECS:
            raise ValueError(f"no frame codec {backend!r}; there are {', '.join(CODECS)}")
        self.width, self.height, self.config = width, height, config
        self.params, self.controls = dict(P.DEFAULTS[self.backend]), P.Controls()
        CODECS[self.backend](width, height, **config)  # checks the settings

    def set_preset(self, name: str) -> Engine:
        self.params = P.preset(self.backend, name)
        return self

    def set_controls(self, **values: float) -> Engine:
        self.controls = P.Controls(**values)
        return self

    def reset_controls(self) -> Engine:
        """All macro controls at their neutral values; preset and parameters stay."""
        self.controls = P.Controls()
        return self

    def set_parameter(self, name: str, value: float) -> Engine:
        self.params = P.with_parameter(self.backend, self.params, name, value)
        return self

    def effective(self) -> dict:
        return P.under_controls(self.backend, self.params, self.controls)

    def codec(self):
        found = self.effective()
        settings = {k[4:]: v for k, v in found.items() if k.startswith("cfg.")}
        return CODECS[self.backend](self.width, self.height, **{**settings, **self.config}, **{k: v for k, v in found.items() if not k.startswith("cfg.")})

    def process(self, frames: DataFrame) -> DataFrame:
        """Frames with any of the control columns (intensity, motion, residual, temporal, bitstream) follow them; where
        a column is missing or null the engine's own control holds."""
        return fold_frames(frames, self.codec, self.width, self.height, self.tuned)

    def tuned(self, values: dict) -> dict:
        """Parameters under controls given for one frame."""
        found = P.under_controls(self.backend, self.params, replace(self.controls, **values))
        return {k: v for k, v in found.items() if not k.startswith("cfg.")}

    def stats(self, frames: DataFrame) -> DataFrame:
        """The counters (stream_id, counter, value) of the same run, with those that all backends have: frames_in,
        keyframes, predicted, blocks_encoded. Codecs without prediction count every frame as a keyframe."""
        codec, w, h = self.codec, self.width, self.height

        def fold(rows: pd.DataFrame) -> pd.DataFrame:
            state = codec()
            for r in rows.sort_values("frame_no").itertuples():
                state.process(np.frombuffer(bytes(r.pixels), np.uint8).reshape(h, w, -1)[..., :3].copy())
            counts = dict(state.counts)
            counts.setdefault("keyframes", counts.get("frames_in", 0))
            counts.setdefault("predicted", 0)
            return pd.DataFrame({"stream_id": rows["stream_id"].iloc[0], "counter": sorted(counts), "value": [int(counts[k]) for k in sorted(counts)]})

        kind = frames.schema["stream_id"].dataType.simpleString()
        return frames.select("stream_id", "frame_no", "pixels").groupBy("stream_id").applyInPandas(fold, f"stream_id {kind}, counter string, value long")


CONTROLS = tuple(P.Controls.__dataclass_fields__)


def one_frame(state, row, width: int, height: int, tuned=None) -> bytes:
    """The next frame of a stream: reset and controls of its row first, then the codec; alpha passes through."""
    if getattr(row, "reset", None):
        state.reset()
    if tuned:
        given = {c: float(v) for c in CONTROLS if (v := getattr(row, c, None)) is not None and not pd.isna(v)}
        if given or hasattr(row, "intensity"):
            state.tune(tuned(given))
    raw = np.frombuffer(bytes(row.pixels), np.uint8)
    if len(raw) not in (width * height * 3, width * height * 4):
        raise ValueError(f"frame {row.frame_no} has {len(raw)} bytes, not {width * height * 3} or {width * height * 4}")
    frame = raw.reshape(height, width, -1)
    return np.concatenate([state.process(frame[..., :3].copy()), frame[..., 3:]], axis=-1).tobytes()


def frame_columns(frames: DataFrame) -> list[str]:
    return ["stream_id", "frame_no", "pixels", *(c for c in ("reset", *CONTROLS) if c in frames.columns)]


def fold_frames(frames: DataFrame, codec, width: int, height: int, tuned=None) -> DataFrame:
    """Frames (stream_id, frame_no, pixels[, reset, controls]) to (stream_id, frame_no, pixels); rgb or rgba, whose
    alpha passes through. ``codec`` makes a fresh codec for a stream. A frame of another size is an error.

    Streams are the unit of parallel work. Within a task they lie one after the other in order of frames, and a frame
    goes out for each that comes in: a task holds a batch of frames (``spark.sql.execution.arrow.maxBytesPerBatch``)
    and one codec, however long its streams are.
    """
    columns = frame_columns(frames)
    kind = frames.schema["stream_id"].dataType
    out = pa.schema([("stream_id", to_arrow_type(kind)), ("frame_no", pa.int64()), ("pixels", pa.binary())])

    def fold(batches):
        stream, state, begun = None, None, False
        for batch in batches:
            for i in range(batch.num_rows):
                row = SimpleNamespace(**{c: batch.column(c)[i].as_py() for c in columns})
                if not begun or row.stream_id != stream:
                    stream, state, begun = row.stream_id, codec(), True
                done = one_frame(state, row, width, height, tuned)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((stream, row.frame_no, done), out.types, strict=True)], schema=out)

    rows = frames.select(*columns).withColumn("frame_no", F.col("frame_no").cast("long"))
    ordered = rows.repartition("stream_id").sortWithinPartitions("stream_id", "frame_no")
    return ordered.mapInArrow(fold, f"stream_id {kind.simpleString()}, frame_no long, pixels binary")
