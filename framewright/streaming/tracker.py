"""The tracker's state, for a batch fold and for a stream of frames."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from framewright.operators import kernels


def mutual_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Mean distance to the nearest point, both ways."""
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    return float((d.min(axis=1).mean() + d.min(axis=0).mean()) / 2)


def _even(strokes: list[np.ndarray]) -> np.ndarray:
    """(stroke, point, 2), shorter strokes filled up with NaN."""
    out = np.full((len(strokes), max(map(len, strokes)), 2), np.nan)
    for s, p in zip(out, strokes, strict=True):
        s[: len(p)] = p
    return out


class Tracker:
    """Strokes of the last frame with their ids, and the next free id."""

    def __init__(self, limit: float):
        self.limit, self.last, self.next_id = limit, [], 1

    def step(self, strokes: list[tuple[str, np.ndarray]]) -> list[int]:
        """Ids of a frame's strokes (kind, points): matched ones keep theirs, the others get new ones in order."""
        cost = np.full((len(strokes), len(self.last)), np.inf)
        for kind in {k for k, _ in strokes} & {k for k, *_ in self.last}:
            i, j = ([r for r, x in enumerate(s) if x[0] == kind] for s in (strokes, self.last))
            cost[np.ix_(i, j)] = kernels.mutual_distances(_even([strokes[r][1] for r in i]), _even([self.last[r][1] for r in j]))
        matched = dict(kernels.assign(cost, self.limit))
        ids = []
        for i in range(len(strokes)):
            if i in matched:
                ids.append(self.last[matched[i]][2])
            else:
                ids.append(self.next_id)
                self.next_id += 1
        self.last = [(kind, p, t) for (kind, p), t in zip(strokes, ids, strict=True)]
        return ids


def track_stream(frames: DataFrame, limit: float) -> DataFrame:
    """(clip, frame, stroke, track_id) of a stream (clip, frame, stroke, type, p) whose frames arrive in order and whole.

    The state of a clip is its last frame's strokes; it lives in the stream's checkpoint.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = pickle.loads(state.get[0]) if state.exists else Tracker(limit)
        pdf = pd.concat(list(batches))
        rows = []
        for frame, part in pdf.sort_values(["frame", "stroke"]).groupby("frame", sort=True):
            ids = tracker.step([(t, np.array([*map(list, p)], float)) for t, p in zip(part.type, part.p, strict=True)])
            rows += [(key[0], int(frame), int(s), i) for s, i in zip(part.stroke, ids, strict=True)]
        state.update((pickle.dumps(tracker),))
        yield pd.DataFrame(rows, columns=["clip", "frame", "stroke", "track_id"])

    return frames.groupBy("clip").applyInPandasWithState(run, "clip long, frame int, stroke long, track_id int", "state binary", "append", "NoTimeout")
