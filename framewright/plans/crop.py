"""Borders to cut off a clip: static bands of one colour in opposite pairs, then static text at top and bottom."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.registry import query
from framewright.sources.views import depth, px

#: The order in which edges are looked at.
EDGES = ("top", "bottom", "left", "right")
OPPOSITE = {"top": "bottom", "bottom": "top", "left": "right", "right": "left"}


@dataclasses.dataclass(frozen=True)
class Crop:
    static: float = 3.0
    static_share: float = 0.99
    uniform: float = 6.0
    least_band: int = 8
    least_area: float = 0.1


class _Box:
    """What is left of a frame, by how much each edge has moved in."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        self.mean, self.deviation, self.cut = mean, deviation, dict.fromkeys(EDGES, 0)

    def bounds(self) -> tuple[int, int, int, int]:
        h, w = self.deviation.shape
        return self.cut["top"], h - self.cut["bottom"], self.cut["left"], w - self.cut["right"]

    def line(self, edge: str) -> tuple[np.ndarray, np.ndarray]:
        """(mean colours, deviations) along the outermost line of an edge."""
        y0, y1, x0, x1 = self.bounds()
        if y0 >= y1 or x0 >= x1:
            return self.mean[:0, 0], self.deviation[:0, 0]
        i = {"top": y0, "bottom": y1 - 1, "left": x0, "right": x1 - 1}[edge]
        at = (i, slice(x0, x1)) if edge in ("top", "bottom") else (slice(y0, y1), i)
        return self.mean[at], self.deviation[at]

    def peel(self, edges, fits: Callable[[np.ndarray, np.ndarray], bool]) -> None:
        """Take lines off these edges for as long as one of them fits."""
        before = None
        while before != self.cut:
            before = dict(self.cut)
            for edge in edges:
                while fits(*self.line(edge)):
                    self.cut[edge] += 1


def find_crop(mean: np.ndarray, deviation: np.ndarray, p: Crop) -> dict[str, int | bool]:
    """The box (inclusive) that remains of a clip with these means (h, w, channels) and deviations over time (h, w).

    Bands are peeled off all edges, then only off those where they and their opposites are wide enough,
    until that holds for all. Too small a rest means no cut at all.
    """

    def static(line: np.ndarray, deviations: np.ndarray) -> bool:
        return len(deviations) > 0 and (deviations <= p.static).mean() >= p.static_share

    def band(line: np.ndarray, deviations: np.ndarray) -> bool:
        return static(line, deviations) and line.std(axis=0).max() <= p.uniform

    edges, h, w = list(EDGES), *deviation.shape
    while True:
        box = _Box(mean, deviation)
        box.peel(edges, band)
        wide = [e for e in edges if min(box.cut[e], box.cut[OPPOSITE[e]]) >= p.least_band]
        if wide == edges:
            break
        edges = wide
    bands = dict(box.cut)
    for e in ("top", "bottom"):
        if bands[e] >= p.least_band:
            box.peel([e], static)
    y0, y1, x0, x1 = box.bounds()
    cut = (y1 - y0) * (x1 - x0) >= p.least_area * h * w
    return {"cut": cut, "x0": x0 if cut else 0, "y0": y0 if cut else 0, "x1": (x1 if cut else w) - 1, "y1": (y1 if cut else h) - 1, **bands, "text_top": box.cut["top"] - bands["top"], "text_bottom": box.cut["bottom"] - bands["bottom"]}


def crops(cells: DataFrame, channels: list[str], p: Crop, clip: str = "clip") -> DataFrame:
    """One row a clip from (clip, frame, y, x, channels): its box, bands and text rows.

    Means and deviations over time are aggregated first, so that one picture a clip is gathered. The
    deviation is that of the channel that moves most; cells that no frame has, and null values, are moving.
    """
    moving = F.greatest(*(F.stddev_pop(c) for c in channels)) if len(channels) > 1 else F.stddev_pop(channels[0])
    stats = cells.groupBy(clip, "y", "x").agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(channels)), moving.alias("deviation"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shape = int(pdf.y.max()) + 1, int(pdf.x.max()) + 1
        mean, deviation = np.zeros((*shape, len(channels))), np.full(shape, np.inf)
        for i in range(len(channels)):
            mean[pdf.y, pdf.x, i] = pdf[f"m{i}"].fillna(0)
        deviation[pdf.y, pdf.x] = pdf.deviation.fillna(np.inf)
        return pd.DataFrame([{clip: key[0], **find_crop(mean, deviation, p)}])

    sizes = ", ".join(f"{c} int" for c in ("x0", "y0", "x1", "y1", *EDGES, "text_top", "text_bottom"))
    return stats.groupBy(clip).applyInPandas(run, f"{clip} {dict(cells.dtypes)[clip]}, cut boolean, {sizes}")


@query("crop_boxes")
def crop_boxes(spark, sf_dir):
    """Boxes of four clips of six frames each, set in a border: two columns at either side that don't move."""
    d = depth(spark, sf_dir).select((F.col("frame") % 4).alias("clip"), "frame", "y", (F.col("x") + 2).alias("x"), F.col("d").alias("v"))
    side = px(spark, sf_dir).where("g = 0 and x < 4").select((F.col("frame") % 4).alias("clip"), "frame", "y", F.when(F.col("x") < 2, F.col("x")).otherwise(F.col("x") + 16).alias("x"), F.lit(0.0).alias("v"))
    return crops(d.unionByName(side), ["v"], Crop(least_band=2))
