"""Group maps and depth to strokes: silhouettes with holes, boundaries of touching groups, occlusion lines.

A frame is the unit of work and bounded; it is gathered in one task by a grouped map, of which there
are as many as frames. All functions take DataFrames and parameters and read the grid from the data.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators import kernels, trace
from framewright.plans.percentile import percentiles
from framewright.plans.stencil import _GRADIENT
from framewright.registry import query
from framewright.sources.views import depth, gmap, with_views

#: The order of kinds in a document.
KINDS = ("silhouette", "hole", "group_boundary", "occlusion")
SCHEMA = "frame int, rank int, kind string, closed boolean, a int, b int, points array<struct<x double, y double>>, strength double"
#: The flattest angle at which an occlusion line may run out to a boundary, and how near it must come.
FLATTEST_DEG, FOOT = 45.0, 1.0


@dataclasses.dataclass(frozen=True)
class Lines:
    """What becomes a line; lengths and areas are cells."""

    least_region: int = 800
    least_hole: int = 200
    least_band: int = 5
    shortest: int = 6
    blur: float = 1.0
    erode: int = 5
    far: float = 7.0
    near: float = 2.0
    least_skeleton: int = 30
    without: tuple[int, ...] = ()
    high: float = 95.0
    low: float = 90.0
    floor: float = 0.0


def raster(pdf: pd.DataFrame, value: str, dtype: type, empty: float = 0) -> np.ndarray:
    """A frame's cells as an array, as large as the cells reach; absent cells are ``empty``."""
    out = np.full((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1), empty, dtype)
    out[pdf.y, pdf.x] = pdf[value]
    return out


def pair_spines(groups: np.ndarray, least: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(a, b, skeleton) for each two groups that touch: the cells of either beside the other, thinned."""
    ids = [int(g) for g in np.unique(groups) if g]
    wide = {g: kernels.dilate(groups == g, list(kernels.EIGHT)) for g in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            band = ((groups == a) & wide[b]) | ((groups == b) & wide[a])
            if (skeleton := trace.spine(band, least)).any():
                yield a, b, skeleton


def occlusion_mask(groups: np.ndarray, z: np.ndarray, p: Lines, t_high: float, t_low: float) -> tuple[np.ndarray, np.ndarray]:
    """(mask, |grad|): ridges with a strong cell, inside the foreground and away from boundaries.

    With 0 < near < far, a ridge that survives as a line is followed on towards the boundary, if it
    gets there at an angle that isn't too flat.
    """
    mag, gx, gy = trace.depth_gradient(z, p.blur)
    weak = trace.ridge(mag, gx, gy) & trace.inner(groups, p.erode) & (mag > t_low)
    strong = trace.parts_with(weak, mag > t_high)
    away = trace.boundary_distance(groups)
    seeds = strong & (groups != 0) & (away >= p.far)
    if not 0 < p.near < p.far:
        return seeds, mag
    alive = np.zeros_like(seeds)
    for g in np.unique(groups[seeds]):
        if g not in p.without:
            alive |= trace.long_parts(trace.spine(seeds & (groups == g), p.least_band), p.least_skeleton)
    kept = trace.parts_with(seeds, alive)
    zone = strong & (groups != 0) & (away >= p.near) & ~seeds
    most = math.ceil((p.far - p.near) / math.sin(math.radians(FLATTEST_DEG)))
    foot = zone & (away < p.near + FOOT)
    back = np.where(foot, 0, trace.steps_from(foot, zone, most))
    return kept | (zone & (trace.steps_from(kept, zone, most) + back <= most)), mag


def frame_strokes(groups: np.ndarray, z: np.ndarray | None, p: Lines, thresholds: tuple[float, float] | None) -> list[tuple]:
    """(kind, closed, a, b, points, strength) of a frame, in a total order: kind, groups, highest point, length, points."""
    at = lambda path: [(x + 0.5, y + 0.5) for y, x in path]
    out = [(kind, True, 0, 0, at(path), None) for kind, _, path in trace.silhouettes(groups != 0, p.least_region, p.least_hole)]
    for a, b, skeleton in pair_spines(groups, p.least_band):
        out += [("group_boundary", False, a, b, at(path), None) for path in trace.trace(skeleton, p.shortest)[0]]
    if z is not None and thresholds is not None:
        mask, mag = occlusion_mask(groups, z, p, *thresholds)
        for g in np.unique(groups[mask]).tolist():
            if g in p.without:
                continue
            skeleton = trace.long_parts(trace.spine(mask & (groups == g), p.least_band), p.least_skeleton)
            for path in trace.trace(skeleton, p.shortest)[0]:
                once = path[:-1] if trace.is_loop(path) else path
                out.append(("occlusion", False, g, 0, at(path), round(float(np.mean([mag[c] for c in once])), 3)))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[2], s[3], min((y, x) for x, y in s[4]), len(s[4]), s[4]))


def clip_thresholds(cells: DataFrame, p: Lines, clip: list[str] | None = None) -> DataFrame:
    """(clip columns, t_high, t_low, n): percentiles of |grad| over the inner foreground of all frames of each clip.

    Cells are (clip columns, frame, y, x, g, d). Clips without inner foreground have null thresholds
    (with a floor: the floor and null).
    """
    clip = clip or []
    types = dict(cells.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in clip) + (", " if clip else "") + "m double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mag = trace.depth_gradient(raster(pdf, "d", np.float64), p.blur)[0][trace.inner(raster(pdf, "g", np.int64), p.erode)]
        out = pd.DataFrame({"m": mag if len(mag) else [np.nan]})
        for c in clip:
            out[c] = pdf[c].iloc[0]
        return out[[*clip, "m"]]

    m = cells.groupBy(*clip, "frame").applyInPandas(run, schema).withColumn("m", F.nanvl("m", F.lit(None)))
    out = percentiles(m, clip, "m", {"t_high": p.high / 100, "t_low": p.low / 100})
    return out.withColumn("t_high", F.greatest("t_high", F.lit(p.floor)) if p.floor > 0 else F.col("t_high"))


def strokes(cells: DataFrame, p: Lines, thresholds: DataFrame | None = None) -> DataFrame:
    """Strokes of each frame of (frame, y, x, g), ranked; occlusion lines need a column d and one row of thresholds (t_high, t_low).

    Frames without cells have no rows; null groups are background, null depths 0; null thresholds mean no occlusion lines.
    """
    cells = cells.withColumn("g", F.coalesce("g", F.lit(0)))
    columns = ["frame", "y", "x", "g"]
    if thresholds is not None:
        cells = cells.withColumn("d", F.coalesce("d", F.lit(0.0))).crossJoin(F.broadcast(thresholds.select("t_high", "t_low")))  # one row
        columns += ["d", "t_high", "t_low"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z = t = None
        if "d" in pdf:
            high, low = pdf.t_high.iloc[0], pdf.t_low.iloc[0]
            z, t = raster(pdf, "d", np.float64), None if pd.isna(high) or pd.isna(low) else (float(high), float(low))
        found = frame_strokes(raster(pdf, "g", np.int64), z, p, t)
        rows = [(int(key[0]), i, kind, closed, a, b, [{"x": x, "y": y} for x, y in points], s) for i, (kind, closed, a, b, points, s) in enumerate(found)]
        return pd.DataFrame(rows, columns=["frame", "rank", "kind", "closed", "a", "b", "points", "strength"]).astype({"strength": "float64"})

    return cells.select(*columns).where("frame is not null and y is not null and x is not null").groupBy("frame").applyInPandas(run, SCHEMA).withColumn("strength", F.nanvl("strength", F.lit(None)))


#: For the fixture's small grid.
SMALL = Lines(least_region=3, least_hole=1, least_band=3, shortest=3, blur=0.8, erode=1, far=0.0, near=0.0, least_skeleton=2, high=80.0, low=50.0)


def _cells(spark, sf_dir) -> DataFrame:
    return gmap(spark, sf_dir).join(depth(spark, sf_dir), ["frame", "y", "x"])


@query("clip_gradient_thresholds", with_views(_GRADIENT.strip() + """,
deep AS (SELECT a.frame, a.y, a.x FROM gmap a JOIN gmap b ON b.frame = a.frame AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL HAVING count(*) FILTER (WHERE b.g <> 0) = 9)
SELECT round(quantile_cont(mag, 0.95), 3) AS t_high, round(quantile_cont(mag, 0.9), 3) AS t_low, count(*) AS n FROM grad JOIN deep USING (frame, y, x)""", "depth", "gmap"))
def clip_gradient_thresholds(spark, sf_dir):
    """Percentiles of |grad| over the foreground eroded by 3 x 3 of all frames."""
    t = clip_thresholds(_cells(spark, sf_dir), Lines(blur=0.0, erode=3))
    return t.select(F.round("t_high", 3).alias("t_high"), F.round("t_low", 3).alias("t_low"), "n")


@query("frame_strokes")
def frame_strokes_query(spark, sf_dir):
    """All strokes of all frames: silhouettes, holes, group boundaries and occlusion lines."""
    cells = _cells(spark, sf_dir)
    return strokes(cells, SMALL, clip_thresholds(cells, SMALL))


@query("group_boundaries")
def group_boundaries(spark, sf_dir):
    """Points of the lines along which two groups touch."""
    s = strokes(gmap(spark, sf_dir), SMALL).where("kind = 'group_boundary'")
    return s.select("frame", "rank", "a", "b", F.posexplode("points").alias("i", "q")).select("frame", "rank", "a", "b", "i", "q.x", "q.y")


@query("silhouettes_with_holes")
def silhouettes_with_holes(spark, sf_dir):
    """Borders of regions of groups 2 and 3, and of the holes in them."""
    m = gmap(spark, sf_dir).withColumn("g", F.when(F.col("g") >= 2, F.col("g")).otherwise(0))
    s = strokes(m, SMALL).where("kind in ('silhouette', 'hole')")
    return s.select("frame", "rank", "kind", F.posexplode("points").alias("i", "q")).select("frame", "rank", "kind", "i", "q.x", "q.y")
