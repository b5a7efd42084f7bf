"""The unit rules as a stateful stream: the state of a stream is its buffer's tail and its fold."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from frameloom.operators.unit_filter import StreamState, split


def filter_stream(chunks: DataFrame, **settings) -> DataFrame:
    """Streaming chunks (stream_id string, chunk_no long, bytes binary, last boolean) to units (stream_id, seq, data).

    Within a batch chunks go by ``chunk_no``; one at or below the last that was taken is dropped. A chunk with
    ``last`` ends its stream: the unit in the buffer comes out and the state goes.
    """
    StreamState.of(**settings)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, tail, seq, done = pickle.loads(state.get[0]) if state.exists else (StreamState.of(**settings), b"", 0, -1)
        out, ended = [], False
        for row in pd.concat(list(frames)).sort_values("chunk_no").itertuples():
            if row.chunk_no <= done or ended:
                continue
            done, ended = row.chunk_no, bool(row.last)
            units, tail = split(tail + bytes(row.bytes or b""))
            if ended:
                more, tail = split(tail, final=True)
                units += more
            for u in units:
                out += held.push(u)
        if ended:
            state.remove()
        else:
            state.update((pickle.dumps((held, tail, seq + len(out), done)),))
        yield pd.DataFrame({"stream_id": key[0], "seq": range(seq + 1, seq + len(out) + 1), "data": out})

    return chunks.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, seq long, data binary", "held binary", "append", GroupStateTimeout.NoTimeout)
