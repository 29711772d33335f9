"""Connected components of group maps and what is decided by component.

Frames are independent and bounded, so a frame's components are found by one kernel call in a
grouped map keyed by frame; everything after that is relational.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators import kernels
from framewright.plans.stencil import _BOUNDARY, _GRADIENT, _NMS, CELL, boundary_distances, ellipse, ridges, square
from framewright.registry import query
from framewright.sources.views import HEIGHT, WIDTH, depth, gmap, with_views


def components(cells: DataFrame, connectivity: int, width: int = WIDTH) -> DataFrame:
    """Adds ``comp``: for each cell of (frame, y, x, g) the raster index, in rows of ``width``, of the first cell of its component of equal g.

    Cells that are absent from a frame connect nothing. A frame is the unit of work, and as large as
    its cells reach; cells beyond ``width`` are an error.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf.y.max()) + 1, int(pdf.x.max()) + 1
        if w > width:
            raise ValueError(f"a frame is {w} cells wide, not {width}")
        grid = np.full((h, w), -1, np.int64)
        grid[pdf.y, pdf.x] = pdf.g
        y, x = np.divmod(kernels.label(grid, connectivity)[pdf.y, pdf.x], w)
        return pdf.assign(comp=(y * width + x).astype(np.int32))

    cells = cells.select(*CELL, F.col("g").cast("int").alias("g"))
    return cells.groupBy("frame").applyInPandas(run, "frame int, y int, x int, g int, comp int")


def _reach(source: str, connectivity: int, name: str = "comp") -> str:
    """SQL: (frame, y, x, g, comp) of the cells of ``source``, by the closure of the neighbour relation."""
    near = "abs(b.y - r.y) + abs(b.x - r.x) = 1" if connectivity == 4 else "abs(b.y - r.y) <= 1 AND abs(b.x - r.x) <= 1"
    return f"""
{name}_r(frame, sy, sx, y, x, g) AS (SELECT frame, y, x, y, x, g FROM {source} UNION SELECT b.frame, r.sy, r.sx, b.y, b.x, b.g FROM {name}_r r JOIN {source} b ON b.frame = r.frame AND b.g = r.g AND {near}),
{name} AS (SELECT frame, sy AS y, sx AS x, any_value(g) AS g, min(y * 16 + x)::INT AS comp FROM {name}_r GROUP BY 1, 2, 3)"""


@query("components_4", with_views(_reach("gmap", 4).strip() + "\nSELECT frame, y, x, g, comp FROM comp", "gmap"))
def components_4(spark, sf_dir):
    return components(gmap(spark, sf_dir), 4)


@query("components_8", with_views(_reach("gmap", 8).strip() + "\nSELECT frame, comp, g, count(*) AS area, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM comp GROUP BY 1, 2, 3", "gmap"))
def components_8(spark, sf_dir):
    c = components(gmap(spark, sf_dir), 8)
    return c.groupBy("frame", "comp", "g").agg(F.count("*").alias("area"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


_FG = "fg AS (SELECT frame, y, x, 1 AS g FROM gmap WHERE g IN (2, 3))"


def _fg(spark, sf_dir) -> DataFrame:
    return gmap(spark, sf_dir).where("g in (2, 3)").withColumn("g", F.lit(1))


@query("big_blobs", with_views(_FG + "," + _reach("fg", 8) + ",\na AS (SELECT frame, comp, count(*) AS n FROM comp GROUP BY 1, 2)\nSELECT frame, count(*) AS parts, count(*) FILTER (WHERE n > 0.05 * 160) AS big, round(max(n) / sum(n), 6) AS share FROM a GROUP BY 1", "gmap"))
def big_blobs(spark, sf_dir):
    a = components(_fg(spark, sf_dir), 8).groupBy("frame", "comp").agg(F.count("*").alias("n"))
    return a.groupBy("frame").agg(F.count("*").alias("parts"), F.count_if(F.col("n") > 0.05 * HEIGHT * WIDTH).alias("big"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


@query("long_components", with_views(_FG + "," + _reach("fg", 8) + "\nSELECT frame, y, x FROM (SELECT *, count(*) OVER (PARTITION BY frame, comp) AS n FROM comp) WHERE n >= 6", "gmap"))
def long_components(spark, sf_dir):
    c = components(_fg(spark, sf_dir), 8)
    return c.withColumn("n", F.count("*").over(Window.partitionBy("frame", "comp"))).where("n >= 6").select(*CELL)


_WEAK = "weak AS (SELECT frame, y, x, 1 AS g, mag FROM nms WHERE ridge AND mag > 40)"


def hysteresis_cells(spark, sf_dir) -> DataFrame:
    weak = ridges(depth(spark, sf_dir)).where("ridge and mag > 40")
    c = components(weak.withColumn("g", F.lit(1)), 8).join(weak.select(*CELL, "mag"), CELL)
    return c.withColumn("strong", F.max("mag").over(Window.partitionBy("frame", "comp")) > 150).where("strong").select(*CELL)


_HYST = _GRADIENT.strip() + "," + _NMS + ",\n" + _WEAK + "," + _reach("weak", 8) + ",\nhyst AS (SELECT c.frame, c.y, c.x FROM (SELECT comp.*, max(mag) OVER (PARTITION BY comp.frame, comp) AS top FROM comp JOIN weak USING (frame, y, x)) c WHERE top > 150)"


@query("hysteresis", with_views(_HYST + "\nSELECT frame, y, x FROM hyst", "depth"))
def hysteresis(spark, sf_dir):
    """Weak ridge cells whose component holds a strong one."""
    return hysteresis_cells(spark, sf_dir)


@query("occlusion_masks", with_views(_HYST + "," + _BOUNDARY + "\nSELECT h.frame, h.y, h.x, d.dist >= 1 AND m.g <> 1 AS dist_ok FROM hyst h JOIN dist d USING (frame, y, x) JOIN gmap m USING (frame, y, x)", "depth", "gmap"))
def occlusion_masks(spark, sf_dir):
    d = boundary_distances(gmap(spark, sf_dir))
    return hysteresis_cells(spark, sf_dir).join(d, CELL).select(*CELL, ((F.col("dist") >= 1) & (F.col("g") != 1)).alias("dist_ok"))


_RING = """
ring AS (SELECT DISTINCT c.frame, c.comp, n.y, n.x, m.g FROM {small} c JOIN gmap n ON n.frame = c.frame AND abs(n.y - c.y) <= 1 AND abs(n.x - c.x) <= 1 JOIN gmap m ON m.frame = n.frame AND m.y = n.y AND m.x = n.x
  WHERE NOT EXISTS (SELECT 1 FROM {small} o WHERE o.frame = n.frame AND o.comp = c.comp AND o.y = n.y AND o.x = n.x))"""


def _rings(small: DataFrame, cells: DataFrame) -> DataFrame:
    """(frame, comp, y, x, g): the cells around each component of (frame, y, x, comp), which aren't part of it."""
    wide = small.select("frame", "comp", "y", "x", F.inline(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in square(3)))))
    wide = wide.select("frame", "comp", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")).distinct()
    return wide.join(small.select("frame", "comp", "y", "x"), ["frame", "comp", "y", "x"], "left_anti").join(cells.select(*CELL, "g"), CELL)


@query("island_filter", with_views(_reach("gmap", 8).strip() + ",\nsmall AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY frame, comp) AS n FROM comp) WHERE n < 3)," + _RING.format(small="small") + """,
vote AS (SELECT frame, comp, g FROM (SELECT frame, comp, g, row_number() OVER (PARTITION BY frame, comp ORDER BY count(*) DESC, g) AS r FROM ring GROUP BY 1, 2, 3) WHERE r = 1)
SELECT m.frame, m.y, m.x, coalesce(v.g, m.g) AS g FROM gmap m LEFT JOIN small s ON s.frame = m.frame AND s.y = m.y AND s.x = m.x LEFT JOIN vote v ON v.frame = s.frame AND v.comp = s.comp""", "gmap"))
def island_filter(spark, sf_dir):
    """Components of fewer than three cells take the most frequent group around them, read from the map as it was."""
    m = gmap(spark, sf_dir)
    c = components(m, 8)
    small = c.withColumn("n", F.count("*").over(Window.partitionBy("frame", "comp"))).where("n < 3")
    vote = _rings(small, m).groupBy("frame", "comp", "g").agg(F.count("*").alias("n")).groupBy("frame", "comp").agg(F.max(F.struct("n", (-F.col("g")).alias("g"))).alias("v"))
    return c.join(vote, ["frame", "comp"], "left").select(*CELL, F.coalesce(-F.col("v.g"), F.col("g")).alias("g"))


_BORDER = "min(y) = 0 OR max(y) = 9 OR min(x) = 0 OR max(x) = 15"


@query("hole_fill", with_views("bg AS (SELECT frame, y, x, g FROM gmap WHERE g = 3)," + _reach("bg", 4) + f""",
free AS (SELECT frame, comp FROM comp GROUP BY 1, 2 HAVING NOT ({_BORDER})), small AS (SELECT c.* FROM comp c JOIN free USING (frame, comp)),""" + _RING.format(small="small") + """,
ok AS (SELECT frame, comp FROM ring GROUP BY 1, 2 HAVING count(DISTINCT g) = 1 AND min(g) = 2)
SELECT m.frame, m.y, m.x, CASE WHEN k.comp IS NOT NULL THEN 2 ELSE m.g END AS g FROM gmap m LEFT JOIN small s ON s.frame = m.frame AND s.y = m.y AND s.x = m.x LEFT JOIN ok k ON k.frame = s.frame AND k.comp = s.comp""", "gmap"))
def hole_fill(spark, sf_dir):
    """Enclosed components of one group that touch nothing but one other group take that one."""
    m = gmap(spark, sf_dir)
    c = components(m.where("g = 3"), 4)
    by = Window.partitionBy("frame", "comp")
    inside = (F.min("y").over(by) > 0) & (F.max("y").over(by) < HEIGHT - 1) & (F.min("x").over(by) > 0) & (F.max("x").over(by) < WIDTH - 1)
    small = c.withColumn("inside", inside).where("inside")
    ok = _rings(small, m).groupBy("frame", "comp").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo = 2 and hi = 2")
    filled = small.join(ok, ["frame", "comp"], "left_semi").select(*CELL, F.lit(2).alias("new"))
    return m.join(filled, CELL, "left").select(*CELL, F.coalesce("new", "g").alias("g"))


def filled_mask(spark, sf_dir, test: str) -> DataFrame:
    """(frame, y, x): the mask with its holes, 4-connected parts of the rest that don't reach the border."""
    m = gmap(spark, sf_dir)
    mask = m.where(test).select(*CELL)
    c = components(m.where(f"not ({test})").withColumn("g", F.lit(0)), 4)
    by = Window.partitionBy("frame", "comp")
    inside = (F.min("y").over(by) > 0) & (F.max("y").over(by) < HEIGHT - 1) & (F.min("x").over(by) > 0) & (F.max("x").over(by) < WIDTH - 1)
    return mask.unionAll(c.withColumn("inside", inside).where("inside").select(*CELL))


_FILLED = "rest AS (SELECT frame, y, x, 0 AS g FROM gmap WHERE g <> 2)," + _reach("rest", 4, "hole") + f""",
mf AS (SELECT frame, y, x FROM gmap WHERE g = 2 UNION ALL SELECT frame, y, x FROM hole JOIN (SELECT frame, comp FROM hole GROUP BY 1, 2 HAVING NOT ({_BORDER})) USING (frame, comp))"""


@query("fill_holes", with_views(_FILLED + "\nSELECT frame, y, x FROM mf", "gmap"))
def fill_holes(spark, sf_dir):
    return filled_mask(spark, sf_dir, "g = 2")


_KEEP, _DROP, _PIECE = 0.6, 0.05, 2


@query("target_keep_cut_drop", with_views(_FILLED + ",\nfg AS (SELECT frame, y, x, 1 AS g FROM gmap WHERE g IN (1, 2))," + _reach("fg", 8, "part") + f""",
off(dy, dx) AS (VALUES {', '.join(map(str, ellipse(1)))}),
md AS (SELECT DISTINCT a.frame, a.y + dy AS y, a.x + dx AS x FROM mf a CROSS JOIN off),
cls AS (SELECT p.frame, p.comp, count(mf.y) / count(*) AS r FROM part p LEFT JOIN mf ON mf.frame = p.frame AND mf.y = p.y AND mf.x = p.x GROUP BY 1, 2),
cut AS (SELECT p.frame, p.y, p.x, 1 AS g FROM part p JOIN cls USING (frame, comp) JOIN md ON md.frame = p.frame AND md.y = p.y AND md.x = p.x WHERE r < {_KEEP} AND r > {_DROP}),""" + _reach("cut", 8, "piece") + f""",
ok AS (SELECT p.frame, p.comp FROM piece p LEFT JOIN mf ON mf.frame = p.frame AND mf.y = p.y AND mf.x = p.x GROUP BY 1, 2 HAVING count(mf.y) >= {_PIECE})
SELECT p.frame, p.y, p.x, 'keep' AS how FROM part p JOIN cls USING (frame, comp) WHERE r >= {_KEEP} UNION ALL SELECT p.frame, p.y, p.x, 'cut' FROM piece p JOIN ok USING (frame, comp)""", "gmap"))
def target_keep_cut_drop(spark, sf_dir):
    """Components kept whole, cut to the widened target or dropped, by the share that lies in the filled target."""
    mf = filled_mask(spark, sf_dir, "g = 2").withColumn("hit", F.lit(1))
    md = mf.select(*CELL, F.inline(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ellipse(1))))).select("frame", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")).distinct()
    part = components(gmap(spark, sf_dir).where("g in (1, 2)").withColumn("g", F.lit(1)), 8).join(mf, CELL, "left")
    part = part.withColumn("r", F.avg(F.coalesce("hit", F.lit(0))).over(Window.partitionBy("frame", "comp")))
    cut = part.where((F.col("r") < _KEEP) & (F.col("r") > _DROP)).join(md, CELL, "left_semi")
    piece = components(cut, 8).join(mf, CELL, "left").withColumn("n", F.sum(F.coalesce("hit", F.lit(0))).over(Window.partitionBy("frame", "comp")))
    return part.where(F.col("r") >= _KEEP).select(*CELL, F.lit("keep").alias("how")).unionAll(piece.where(F.col("n") >= _PIECE).select(*CELL, F.lit("cut").alias("how")))


@query("reach_extension", with_views("""
zone AS (SELECT frame, y, x FROM gmap WHERE g = 3),
s(frame, y, x, d) AS (SELECT frame, y, x, 0 FROM gmap WHERE g = 2 UNION SELECT z.frame, z.y, z.x, s.d + 1 FROM s JOIN zone z ON z.frame = s.frame AND abs(z.y - s.y) <= 1 AND abs(z.x - s.x) <= 1 WHERE s.d < 3),
t(frame, y, x, d) AS (SELECT frame, y, x, 0 FROM zone WHERE y = 9 UNION SELECT z.frame, z.y, z.x, t.d + 1 FROM t JOIN zone z ON z.frame = t.frame AND abs(z.y - t.y) <= 1 AND abs(z.x - t.x) <= 1 WHERE t.d < 3)
SELECT a.frame, a.y, a.x, a.d + b.d AS steps FROM (SELECT frame, y, x, min(d) AS d FROM s WHERE d > 0 GROUP BY 1, 2, 3) a JOIN (SELECT frame, y, x, min(d) AS d FROM t GROUP BY 1, 2, 3) b USING (frame, y, x) WHERE a.d + b.d <= 3""", "gmap"))
def reach_extension(spark, sf_dir):
    """Zone cells on a short way from a seed to the foot of the zone: breadth first from both, three steps at most."""
    m = gmap(spark, sf_dir)
    zone = m.where("g = 3").select(*CELL)
    near = F.inline(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in square(3))))

    def steps(start: DataFrame, name: str) -> DataFrame:
        seen = start.select(*CELL, F.lit(0).alias(name))
        last = seen
        for d in range(1, 4):
            step = last.select("frame", "y", "x", near).select("frame", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")).distinct()
            last = step.join(zone, CELL, "left_semi").join(seen, CELL, "left_anti").withColumn(name, F.lit(d))
            seen = seen.unionAll(last)
        return seen

    s = steps(m.where("g = 2"), "ds").where("ds > 0")
    t = steps(zone.where(f"y = {HEIGHT - 1}"), "dt")
    return s.join(t, CELL).withColumn("steps", F.col("ds") + F.col("dt")).where("steps <= 3").select(*CELL, "steps")


def _frames(cells: DataFrame, kernel, schema: str) -> DataFrame:
    """One kernel call for each frame's mask."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1), bool)
        grid[pdf.y, pdf.x] = True
        return kernel(int(key[0]), grid)

    return cells.groupBy("frame").applyInPandas(run, schema)


@query("skeleton")
def skeleton(spark, sf_dir):
    def one(frame: int, grid: np.ndarray) -> pd.DataFrame:
        y, x = np.nonzero(kernels.thin(grid))
        return pd.DataFrame({"frame": np.full(len(y), frame, np.int32), "y": y.astype(np.int32), "x": x.astype(np.int32)})

    return _frames(_fg(spark, sf_dir), one, "frame int, y int, x int")


@query("silhouettes")
def silhouettes(spark, sf_dir):
    def one(frame: int, grid: np.ndarray) -> pd.DataFrame:
        rows = [(frame, k, i, x, y) for k, path in enumerate(kernels.outline(grid)) for i, (x, y) in enumerate(path)]
        return pd.DataFrame(rows, columns=["frame", "part", "i", "x", "y"])

    return _frames(_fg(spark, sf_dir), one, "frame int, part int, i int, x double, y double")
