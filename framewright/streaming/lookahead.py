"""Smoothing over a window that looks ahead, on a stream: a frame waits until its window is complete."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState


def smooth_stream(frames: DataFrame, rho: float, radius: int) -> DataFrame:
    """(clip, i, v) of a stream (clip, i, v, last): the weighted mean over i - radius to i + radius.

    A frame is emitted once frame i + radius has come, or the one marked ``last``: never with a
    truncated window before that. The state of a clip holds 2 * radius + 1 frames at most, besides
    those that came early.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, nxt, end = pickle.loads(state.get[0]) if state.exists else ({}, 0, None)
        for pdf in batches:
            for i, v, last in zip(pdf.i, pdf.v, pdf["last"], strict=True):
                held[int(i)] = float(v)
                end = int(i) if last else end
        rows = []
        while nxt in held and all(k in held for k in range(nxt, min(nxt + radius, end if end is not None else nxt + radius) + 1)):
            near = [(rho ** abs(k - nxt), held[k]) for k in range(max(nxt - radius, 0), nxt + radius + 1) if k in held and (end is None or k <= end)]
            rows.append((key[0], nxt, sum(w * v for w, v in near) / sum(w for w, _ in near)))
            held.pop(nxt - radius, None)
            nxt += 1
        state.update((pickle.dumps((held, nxt, end)),))
        yield pd.DataFrame(rows, columns=["clip", "i", "v"]).astype({"clip": "int64", "i": "int32", "v": "float64"})

    return frames.groupBy("clip").applyInPandasWithState(run, "clip long, i int, v double", "state binary", "append", "NoTimeout")
