"""The frame codecs as stateful streams: the state of a stream is its codec."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from frameloom.plans.engine import Engine, frame_columns, one_frame


def process_stream(frames: DataFrame, engine: Engine) -> DataFrame:
    """Streaming frames (stream_id string, frame_no long, pixels binary[, reset, controls]) through an engine.

    Within a batch frames go by ``frame_no``; one at or below the last that was taken is late and dropped, as a
    second delivery of the same frame is.
    """
    codec, w, h, tuned = engine.codec, engine.width, engine.height, engine.tuned

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, done = pickle.loads(state.get[0]) if state.exists else (codec(), None)
        numbers, out = [], []
        for row in pd.concat(list(parts)).sort_values("frame_no").itertuples():
            if done is None or row.frame_no > done:
                done = row.frame_no
                numbers.append(done)
                out.append(one_frame(held, row, w, h, tuned))
        state.update((pickle.dumps((held, done)),))
        yield pd.DataFrame({"stream_id": key[0], "frame_no": numbers, "pixels": out})

    rows = frames.select(*frame_columns(frames))
    return rows.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, frame_no long, pixels binary", "held binary", "append", GroupStateTimeout.NoTimeout)
