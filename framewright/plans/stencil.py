"""Neighbourhood operators: a kernel over each frame, whose cells are moved once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators import stencils, trace
from framewright.registry import query
from framewright.sources.views import depth, gmap, with_views

CELL = ["frame", "y", "x"]


def square(k: int) -> list[tuple[int, int]]:
    r = k // 2
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def ellipse(d: int) -> list[tuple[int, int]]:
    """Offsets of the elliptic kernel of radius d: each row as wide as the circle there, rounded."""
    out = []
    for dy in range(-d, d + 1):
        w = int(round((d * d - dy * dy) ** 0.5))
        out += [(dy, dx) for dx in range(-w, w + 1)]
    return out


def frame_map(cells: DataFrame, values: list[str], kernel: Callable[..., dict[str, np.ndarray]], out: str) -> DataFrame:
    """(frame, y, x, out): a kernel over the arrays of each frame, for the cells that the frame has.

    The arrays reach as far as the frame's cells; cells that are absent, and nulls, are 0. ``out`` is
    the schema of what the kernel returns by name; NaN becomes null. A frame is the unit of work, and
    its cells are moved once, whatever the size of the neighbourhood.
    """
    types = dict(cells.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        arrays = []
        for v in values:
            a = np.zeros((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1), np.float64 if types[v] in ("double", "float") else np.int64)
            a[pdf.y, pdf.x] = pdf[v].fillna(0)
            arrays.append(a)
        found = kernel(*arrays)
        return pd.DataFrame({"frame": key[0], "y": pdf.y, "x": pdf.x, **{k: a[pdf.y, pdf.x] for k, a in found.items()}})

    done = cells.select(*CELL, *values).groupBy("frame").applyInPandas(run, f"frame {types['frame']}, y {types['y']}, x {types['x']}, {out}")
    doubles = [k for k, t in done.dtypes if t == "double"]
    return done.withColumns({k: F.nanvl(k, F.lit(None)) for k in doubles}) if doubles else done


_AROUND = "JOIN {t} b ON b.frame = a.frame AND b.y BETWEEN a.y - {r} AND a.y + {r} AND b.x BETWEEN a.x - {r} AND a.x + {r}"


def modes(groups: DataFrame, k: int) -> DataFrame:
    """(frame, y, x, g): the most frequent group of each k x k window, the edge repeated; the own group wins a tie, then the smallest."""
    return frame_map(groups, ["g"], lambda g: {"g": stencils.most_frequent(g, square(k))}, "g int")


@query("mode_filter", with_views("""
off AS (SELECT dy.i::INT AS dy, dx.i::INT AS dx FROM range(-1, 2) dy(i), range(-1, 2) dx(i)),
n AS (SELECT a.frame, a.y, a.x, a.g AS own, b.g, count(*) AS n FROM gmap a CROSS JOIN off JOIN gmap b ON b.frame = a.frame AND b.y = greatest(0, least(9, a.y + dy)) AND b.x = greatest(0, least(15, a.x + dx)) GROUP BY ALL)
SELECT frame, y, x, g FROM (SELECT *, row_number() OVER (PARTITION BY frame, y, x ORDER BY n DESC, g = own DESC, g) AS r FROM n) WHERE r = 1""", "gmap"))
def mode_filter(spark, sf_dir):
    """The most frequent group of a 3 x 3 window, the edge repeated; the own group wins a tie, then the smallest."""
    return modes(gmap(spark, sf_dir), 3)


@query("erode_mask", with_views(f"SELECT a.frame, a.y, a.x, count(*) FILTER (WHERE b.g <> 1) = 9 AS inner FROM gmap a {_AROUND.format(t='gmap', r=1)} GROUP BY ALL".replace("AS inner", 'AS "inner"'), "gmap"))
def erode_mask(spark, sf_dir):
    """Cells whose whole 3 x 3 window lies in the mask; outside the frame is background."""
    mask = gmap(spark, sf_dir).withColumn("m", (F.col("g") != 1).cast("int"))
    return frame_map(mask, ["m"], lambda m: {"inner": stencils.all_of(m > 0, square(3))}, "inner boolean")


_ELLIPSE = ", ".join(f"({dy}, {dx})" for dy, dx in ellipse(2))


@query("dilate_mask", with_views(f"off(dy, dx) AS (VALUES {_ELLIPSE})\nSELECT a.frame, a.y, a.x, bool_or(b.g = 3) AS wide FROM gmap a CROSS JOIN off JOIN gmap b ON b.frame = a.frame AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL", "gmap"))
def dilate_mask(spark, sf_dir):
    return frame_map(gmap(spark, sf_dir), ["g"], lambda g: {"wide": stencils.any_of(g == 3, ellipse(2))}, "wide boolean")


#: 3 x 3 derivative weights across and down.
SOBEL_X = [(-1, -1, -1), (-1, 1, 1), (0, -1, -2), (0, 1, 2), (1, -1, -1), (1, 1, 1)]
SOBEL_Y = [(dx, dy, w) for dy, dx, w in SOBEL_X]


def gradient(cells: DataFrame) -> DataFrame:
    """(frame, y, x, gx, gy, mag) of (frame, y, x, d): derivative over 8, the border mirrored."""

    def kernel(d: np.ndarray) -> dict[str, np.ndarray]:
        gx, gy = (np.round(stencils.weighted(d, k, "reflect"), 5) / 8 for k in (SOBEL_X, SOBEL_Y))
        return {"gx": gx, "gy": gy, "mag": np.sqrt(gx * gx + gy * gy)}

    return frame_map(cells, ["d"], kernel, "gx double, gy double, mag double")


_FOLD = "CASE WHEN {a} < 0 THEN -({a}) WHEN {a} > {m} THEN 2 * {m} - ({a}) ELSE {a} END"
_GRADIENT = f"""
kx(dy, dx, w) AS (VALUES {', '.join(map(str, SOBEL_X))}),
gx AS (SELECT a.frame, a.y, a.x, round(sum(w * b.d), 5) / 8 AS gx FROM depth a CROSS JOIN kx JOIN depth b ON b.frame = a.frame AND b.y = {_FOLD.format(a='a.y + dy', m=9)} AND b.x = {_FOLD.format(a='a.x + dx', m=15)} GROUP BY ALL),
gy AS (SELECT a.frame, a.y, a.x, round(sum(w * b.d), 5) / 8 AS gy FROM depth a CROSS JOIN kx JOIN depth b ON b.frame = a.frame AND b.y = {_FOLD.format(a='a.y + dx', m=9)} AND b.x = {_FOLD.format(a='a.x + dy', m=15)} GROUP BY ALL),
grad AS (SELECT frame, y, x, gx, gy, sqrt(gx * gx + gy * gy) AS mag FROM gx JOIN gy USING (frame, y, x))"""


@query("sobel_gradient", with_views(_GRADIENT.strip() + "\nSELECT frame, y, x, gx, gy, mag FROM grad", "depth"))
def sobel_gradient(spark, sf_dir):
    return gradient(depth(spark, sf_dir))


_GAUSS = [(dy, dx, w) for dy, dx, w in ((a, b, round(2.718281828459045 ** (-(a * a + b * b) / 2), 9)) for a in (-2, -1, 0, 1, 2) for b in (-2, -1, 0, 1, 2))]


@query("gaussian_blur", with_views(f"k(dy, dx, w) AS (VALUES {', '.join(map(str, _GAUSS))})\nSELECT a.frame, a.y, a.x, round(sum(w::DOUBLE * b.d) / sum(w::DOUBLE), 4) AS d FROM depth a CROSS JOIN k JOIN depth b ON b.frame = a.frame AND b.y = {_FOLD.format(a='a.y + dy', m=9)} AND b.x = {_FOLD.format(a='a.x + dx', m=15)} GROUP BY ALL", "depth"))
def gaussian_blur(spark, sf_dir):
    mass = sum(w for _, _, w in _GAUSS)
    blurred = frame_map(depth(spark, sf_dir), ["d"], lambda d: {"d": stencils.weighted(d, _GAUSS, "reflect") / mass}, "d double")
    return blurred.select(*CELL, F.round("d", 4).alias("d"))


#: The two neighbours across an edge, for the four directions of the gradient.
_ACROSS = [[(0, -1), (0, 1)], [(-1, -1), (1, 1)], [(-1, 0), (1, 0)], [(-1, 1), (1, -1)]]
_SECTOR = "CASE WHEN a < 22.5 OR a >= 157.5 THEN 0 WHEN a < 67.5 THEN 1 WHEN a < 112.5 THEN 2 ELSE 3 END"
_NMS = (
    f"""
sec AS (SELECT *, {_SECTOR} AS sector FROM (SELECT *, fmod(degrees(atan2(gy, gx)) + 180.0, 180.0) AS a FROM grad)),
off(sector, dy, dx) AS (VALUES {', '.join(f'({s}, {dy}, {dx})' for s, p in enumerate(_ACROSS) for dy, dx in p)}),
nms AS (SELECT c.frame, c.y, c.x, any_value(c.mag) AS mag, bool_and(c.mag >= n.mag) AND any_value(c.mag) > 0 AS ridge FROM sec c JOIN off USING (sector) JOIN grad n ON n.frame = c.frame AND n.y = greatest(0, least(9, c.y + dy)) AND n.x = greatest(0, least(15, c.x + dx)) GROUP BY 1, 2, 3)"""
)


def ridges(cells: DataFrame) -> DataFrame:
    """(frame, y, x, mag, ridge) of (frame, y, x, d): cells not below either neighbour across the gradient, of which there are four directions."""

    def kernel(mag: np.ndarray, gx: np.ndarray, gy: np.ndarray) -> dict[str, np.ndarray]:
        angle = (np.degrees(np.arctan2(gy, gx)) + 180.0) % 180.0
        sector = np.where((angle < 22.5) | (angle >= 157.5), 0, np.where(angle < 67.5, 1, np.where(angle < 112.5, 2, 3)))
        top = [np.maximum(*(stencils.shifted(mag, dy, dx, "edge") for dy, dx in pair)) for pair in _ACROSS]
        return {"mag": mag, "ridge": (mag > 0) & (mag >= np.choose(sector, top))}

    return frame_map(gradient(cells), ["mag", "gx", "gy"], kernel, "mag double, ridge boolean")


@query("nms", with_views(_GRADIENT.strip() + "," + _NMS + "\nSELECT frame, y, x, ridge FROM nms", "depth"))
def nms(spark, sf_dir):
    return ridges(depth(spark, sf_dir)).select(*CELL, "ridge")


_BOUNDARY = """
pad AS (SELECT f.i::INT AS frame, y.i::INT AS y, x.i::INT AS x, coalesce(g, 0) AS g FROM range(24) f(i) CROSS JOIN range(-2, 12) y(i) CROSS JOIN range(-2, 18) x(i) LEFT JOIN gmap ON gmap.frame = f.i AND gmap.y = y.i AND gmap.x = x.i),
bnd AS (SELECT a.frame, a.y, a.x FROM pad a JOIN pad b ON b.frame = a.frame AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 WHERE a.y BETWEEN -1 AND 10 AND a.x BETWEEN -1 AND 16 GROUP BY ALL HAVING min(b.g) <> max(b.g)),
dist AS (SELECT a.frame, a.y, a.x, round(min(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)), 6) AS dist FROM gmap a LEFT JOIN bnd b ON b.frame = a.frame GROUP BY ALL)"""


def boundary_distances(groups: DataFrame) -> DataFrame:
    """(frame, y, x, g, dist) of (frame, y, x, g): to the nearest cell next to another group; the frame is surrounded by background. Null where there is none."""

    def kernel(g: np.ndarray) -> dict[str, np.ndarray]:
        d = trace.boundary_distance(g)
        return {"g": g, "dist": np.where(np.isfinite(d), d, np.nan)}

    return frame_map(groups, ["g"], kernel, "g int, dist double").withColumn("dist", F.round("dist", 6))


@query("boundary_distance", with_views(_BOUNDARY.strip() + "\nSELECT frame, y, x, dist FROM dist", "gmap"))
def boundary_distance(spark, sf_dir):
    return boundary_distances(gmap(spark, sf_dir)).select(*CELL, "dist")


@query("pair_band", with_views(f"SELECT DISTINCT a.frame, a.y, a.x, least(a.g, b.g) AS lo, greatest(a.g, b.g) AS hi FROM gmap a {_AROUND.format(t='gmap', r=1)} WHERE a.g <> b.g AND a.g > 0 AND b.g > 0", "gmap"))
def pair_band(spark, sf_dir):
    """Cells of a group that touch another group, for each pair of groups."""
    return pair_cells(gmap(spark, sf_dir))


def pair_cells(groups: DataFrame) -> DataFrame:
    """(frame, y, x, lo, hi): cells of (frame, y, x, g) that touch another group, background apart, once for each such pair."""

    def kernel(g: np.ndarray) -> dict[str, np.ndarray]:
        near = np.stack([stencils.shifted(g, dy, dx, "constant") for dy, dx in square(3)], axis=2)
        there = np.where((near != g[..., None]) & (near > 0) & (g[..., None] > 0), near, 0)
        out = np.empty(g.shape, object)
        for at in np.argwhere(there.any(2)).tolist():
            out[tuple(at)] = sorted(set(there[tuple(at)].tolist()) - {0})
        return {"g": g, "others": out}

    touching = frame_map(groups, ["g"], kernel, "g int, others array<int>").select(*CELL, "g", F.explode("others").alias("other"))
    return touching.select(*CELL, F.least("g", "other").alias("lo"), F.greatest("g", "other").alias("hi"))


#: The eight neighbours in a circle.
RING = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


@query("crossing_number", with_views(f"""
ring(k, dy, dx) AS (VALUES {', '.join(f'({k}, {dy}, {dx})' for k, (dy, dx) in enumerate(RING))}),
v AS (SELECT a.frame, a.y, a.x, k, coalesce(b.g = 3, false)::INT AS v FROM gmap a CROSS JOIN ring LEFT JOIN gmap b ON b.frame = a.frame AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.g = 3)
SELECT p.frame, p.y, p.x, sum((p.v = 0 AND q.v = 1)::INT)::BIGINT AS crossings, sum((p.v = 0 AND q.v = 1)::INT) >= 3 AS junction FROM v p JOIN v q ON q.frame = p.frame AND q.y = p.y AND q.x = p.x AND q.k = (p.k + 1) % 8 GROUP BY 1, 2, 3""", "gmap"))
def crossing_number(spark, sf_dir):
    """How often the circle around a mask cell enters the mask; three times and more make a junction."""
    m = gmap(spark, sf_dir).where("g = 3")

    def kernel(g: np.ndarray) -> dict[str, np.ndarray]:
        n, junction = stencils.entries(g == 3)
        return {"crossings": n, "junction": junction}

    return frame_map(m, ["g"], kernel, "crossings long, junction boolean")
