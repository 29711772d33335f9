"""Colour, ink and texture: what is drawn from coverage, and how drawings are compared."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.plans.percentile import percentiles
from framewright.registry import query
from framewright.sources.views import HEIGHT, WIDTH, depth, gmap, poly, px, with_views

PAPER, INK = (250, 246, 238), (30, 34, 40)


@query("ink_lut", f"""
SELECT i::INT AS level, {', '.join(f'round_even({p} * (1 - i / 255.0::DOUBLE) + {k} * (i / 255.0::DOUBLE), 0)::INT AS {c}' for c, p, k in zip('rgb', PAPER, INK))} FROM range(256) t(i)""")
def ink_lut(spark, sf_dir):
    """Colour of each of 256 levels of ink on paper."""
    a = F.col("id") / 255.0
    return spark.range(256).select(F.col("id").cast("int").alias("level"), *(F.rint(p * (1 - a) + k * a).cast("int").alias(c) for c, p, k in zip("rgb", PAPER, INK)))


@query("level_inverse", with_views(f"""
lut AS (SELECT i AS level, round_even({PAPER[0]} * (1 - i / 255.0::DOUBLE) + {INK[0]} * (i / 255.0::DOUBLE), 0)::INT AS r FROM range(256) t(i)), inv AS (SELECT r, avg(level) AS level FROM lut GROUP BY 1)
SELECT px.frame, px.y, px.x, px.g, round(inv.level, 6) AS level FROM px LEFT JOIN inv ON inv.r = 30 + px.s % 256""", "px"))
def level_inverse(spark, sf_dir):
    """From a colour back to its level of ink: the mean of the levels that share it; unknown colours are null."""
    inv = ink_lut(spark, sf_dir).groupBy("r").agg(F.round(F.avg("level"), 6).alias("level"))
    cells = px(spark, sf_dir).withColumn("r", (30 + F.col("s") % 256).cast("int"))
    return cells.join(F.broadcast(inv), "r", "left").select("frame", "y", "x", "g", "level")  # at most 256 rows


@query("ink_over_product", with_views("SELECT frame, y, x, round(1 - product(1 - 0.5 * (s % 100) / 100.0::DOUBLE), 12) AS ink FROM px GROUP BY 1, 2, 3", "px"))
def ink_over_product(spark, sf_dir):
    """Layers over each other: what none of them covers shows through."""
    return px(spark, sf_dir).groupBy("frame", "y", "x").agg(F.round(1 - F.product(1 - 0.5 * (F.col("s") % 100) / 100.0), 12).alias("ink"))


@query("ink_box", with_views("SELECT frame, greatest(min(floor(x - 1.5)), -40)::BIGINT AS x0, greatest(min(floor(y - 1.5)), -40)::BIGINT AS y0, least(max(ceil(x + 1.5)), 40)::BIGINT AS x1, least(max(ceil(y + 1.5)), 40)::BIGINT AS y1 FROM poly GROUP BY 1", "poly"))
def ink_box(spark, sf_dir):
    lo = lambda c: F.greatest(F.min(F.floor(F.col(c) - 1.5)), F.lit(-40))
    hi = lambda c: F.least(F.max(F.ceil(F.col(c) + 1.5)), F.lit(40))
    return poly(spark, sf_dir).groupBy("frame").agg(lo("x").alias("x0"), lo("y").alias("y0"), hi("x").alias("x1"), hi("y").alias("y1"))


@query("vignette", with_views("SELECT frame, y, x, round(d * (1 - 0.4 * ((y - 4.5) * (y - 4.5) / 20.25 + (x - 7.5) * (x - 7.5) / 56.25) / 2), 5) AS d FROM depth", "depth"))
def vignette(spark, sf_dir):
    dy, dx = F.col("y") - (HEIGHT - 1) / 2, F.col("x") - (WIDTH - 1) / 2
    fall = (dy * dy / 20.25 + dx * dx / 56.25) / 2
    return depth(spark, sf_dir).select("frame", "y", "x", F.round(F.col("d") * (1 - 0.4 * fall), 5).alias("d"))


@query("texture_multiplier", with_views("SELECT frame, y, x, round(0.4 + 0.6 * greatest(1 + 1.5 * (d / (SELECT avg(d) FROM depth) - 1), 0.1), 5) AS m FROM depth", "depth"))
def texture_multiplier(spark, sf_dir):
    """Texture over its mean, stretched by a gain, floored and mixed in by its opacity."""
    d = depth(spark, sf_dir)
    mean = d.agg(F.avg("d").alias("mean"))
    return d.join(F.broadcast(mean)).select("frame", "y", "x", F.round(0.4 + 0.6 * F.greatest(1 + 1.5 * (F.col("d") / F.col("mean") - 1), F.lit(0.1)), 5).alias("m"))  # one row


@query("orient_texture", with_views("SELECT frame, x AS y, 9 - y AS x, g FROM gmap", "gmap"))
def orient_texture(spark, sf_dir):
    return gmap(spark, sf_dir).select("frame", F.col("x").alias("y"), (HEIGHT - 1 - F.col("y")).alias("x"), "g")


@query("cover_crop", with_views("SELECT frame, y, x - 3 AS x, g FROM gmap WHERE x BETWEEN 3 AND 12", "gmap"))
def cover_crop(spark, sf_dir):
    return gmap(spark, sf_dir).where("x between 3 and 12").select("frame", "y", (F.col("x") - 3).alias("x"), "g")


@query("pad_even", with_views("SELECT frame, y, x, g FROM gmap WHERE x < 15 UNION ALL SELECT f.i::INT, y.i::INT, 15, 9 FROM range(24) f(i), range(10) y(i)", "gmap"))
def pad_even(spark, sf_dir):
    """A frame of odd width gets a column of background."""
    cells = gmap(spark, sf_dir).where("x < 15")
    pad = spark.range(24 * HEIGHT).select((F.col("id") / HEIGHT).cast("int").alias("frame"), (F.col("id") % HEIGHT).cast("int").alias("y"), F.lit(15).alias("x"), F.lit(9).alias("g"))
    return cells.unionAll(pad)


@query("luminance", with_views("SELECT frame, y, x, round(0.299 * (s[1] % 256) + 0.587 * (s[2] % 256) + 0.114 * (s[3] % 256), 3)::DOUBLE AS luma FROM (SELECT frame, y, x, list(s ORDER BY g) AS s FROM px GROUP BY 1, 2, 3)", "px"))
def luminance(spark, sf_dir):
    band = lambda g: F.max(F.when(F.col("g") == g, F.col("s") % 256))
    return px(spark, sf_dir).groupBy("frame", "y", "x").agg(F.round(0.299 * band(0) + 0.587 * band(1) + 0.114 * band(2), 3).alias("luma"))


_PAIR = "pair AS (SELECT a.frame, a.y, a.x, a.s % 256 AS p, b.s % 256 AS q FROM px a JOIN px b ON b.frame = a.frame AND b.y = a.y AND b.x = a.x AND a.g = 1 AND b.g = 2)"


def _pair(spark, sf_dir):
    band = lambda g: F.max(F.when(F.col("g") == g, F.col("s") % 256))
    return px(spark, sf_dir).groupBy("frame", "y", "x").agg(band(1).alias("p"), band(2).alias("q"))


@query("psnr", with_views(_PAIR + "\nSELECT frame, round(10 * log10(65025.0::DOUBLE / avg((p - q) * (p - q))), 4) AS psnr FROM pair GROUP BY 1", "px"))
def psnr(spark, sf_dir):
    d = F.col("p") - F.col("q")
    return _pair(spark, sf_dir).groupBy("frame").agg(F.round(10 * F.log10(65025.0 / F.avg(d * d)), 4).alias("psnr"))


@query("ink_metrics", with_views(_PAIR + "\nSELECT frame, count(*) FILTER (WHERE p < 200) AS ink, round(avg(abs(p - q)) FILTER (WHERE p < 200), 4) AS mae, max(abs(p - q)) FILTER (WHERE p < 200) AS worst, round(avg(p - q) FILTER (WHERE p >= 200), 4) AS flat FROM pair GROUP BY 1", "px"))
def ink_metrics(spark, sf_dir):
    d, ink = F.col("p") - F.col("q"), F.col("p") < 200
    return _pair(spark, sf_dir).groupBy("frame").agg(F.count_if(ink).alias("ink"), F.round(F.avg(F.when(ink, F.abs(d))), 4).alias("mae"), F.max(F.when(ink, F.abs(d))).alias("worst"), F.round(F.avg(F.when(~ink, d)), 4).alias("flat"))


@query("winding", with_views("""
e AS (SELECT a.stroke, a.x, a.y, b.x AS qx, b.y AS qy FROM poly a JOIN poly b ON b.stroke = a.stroke AND b.j = (a.j + 1) % 32), pt(px_, py_) AS (VALUES (0, 0), (4, 3), (-5, 2))
SELECT stroke, px_::INT AS px, py_::INT AS py, sum(CASE WHEN (y > py_) <> (qy > py_) AND px_ < (qx - x) * (py_ - y) / (qy - y) + x THEN CASE WHEN qy > y THEN 1 ELSE -1 END ELSE 0 END)::BIGINT AS winding FROM e CROSS JOIN pt GROUP BY 1, 2, 3""", "poly"))
def winding(spark, sf_dir):
    """How often a closed stroke goes around a point."""
    from framewright.plans.polyline import ahead, strokes

    def around(px_: float, py_: float):
        def cross(a, b):
            side = F.when(b["y"] > a["y"], 1).otherwise(-1)
            meets = px_ < (b["x"] - a["x"]) * (py_ - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"]
            return F.when(((a["y"] > py_) != (b["y"] > py_)) & meets, side).otherwise(0)

        return F.struct(F.lit(int(px_)).alias("px"), F.lit(int(py_)).alias("py"), F.aggregate(F.zip_with("p", ahead("p"), cross), F.lit(0).cast("long"), lambda s, v: s + v).alias("winding"))

    return strokes(spark, sf_dir).select("stroke", F.inline(F.array(around(0.0, 0.0), around(4.0, 3.0), around(-5.0, 2.0))))


@query("flipflops", with_views("""
f AS (SELECT frame, y, x, g, lag(g) OVER w AS p, lead(g) OVER w AS n FROM gmap WINDOW w AS (PARTITION BY y, x ORDER BY frame))
SELECT frame, count(*) FILTER (WHERE g <> p AND n = p) AS flips, round(count(*) FILTER (WHERE g <> p AND n = p) * 10000 / nullif(count(*) FILTER (WHERE g <> 1), 0), 4) AS per_10k FROM f GROUP BY 1""", "gmap"))
def flipflops(spark, sf_dir):
    """Cells that change and change back at once, also for each ten thousand cells of foreground."""
    w = Window.partitionBy("y", "x").orderBy("frame")
    f = gmap(spark, sf_dir).withColumn("p", F.lag("g").over(w)).withColumn("n", F.lead("g").over(w))
    flips, fg = F.count_if((F.col("g") != F.col("p")) & (F.col("n") == F.col("p"))), F.count_if(F.col("g") != 1)
    return f.groupBy("frame").agg(flips.alias("flips"), F.round(flips * 10000 / F.nullif(fg, F.lit(0)), 4).alias("per_10k"))


@query("centroids", with_views("""
c AS (SELECT frame, g, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM gmap GROUP BY 1, 2)
SELECT a.frame, a.g, a.n, round(a.cx, 5) AS cx, round(a.cy, 5) AS cy, round(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)), 5) AS speed FROM c a LEFT JOIN c b ON b.g = a.g AND b.frame = a.frame - 1""", "gmap"))
def centroids(spark, sf_dir):
    c = gmap(spark, sf_dir).groupBy("frame", "g").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"))
    b = c.select((F.col("frame") + 1).alias("frame"), "g", F.col("cx").alias("bx"), F.col("cy").alias("by"))
    dx, dy = F.col("cx") - F.col("bx"), F.col("cy") - F.col("by")
    return c.join(b, ["frame", "g"], "left").select("frame", "g", "n", F.round("cx", 5).alias("cx"), F.round("cy", 5).alias("cy"), F.round(F.sqrt(dx * dx + dy * dy), 5).alias("speed"))


@query("group_iou", with_views("""
n AS (SELECT frame, y, x, g, lead(g) OVER (PARTITION BY y, x ORDER BY frame) AS n FROM gmap), gs AS (SELECT unnest([0, 1, 2, 3]) AS k)
SELECT frame, k, round(count(*) FILTER (WHERE g = k AND n = k) / nullif(count(*) FILTER (WHERE g = k OR n = k), 0), 6) AS iou, round(count(*) FILTER (WHERE (g = k) <> (n = k)) / count(*), 6) AS xor FROM n CROSS JOIN gs WHERE n IS NOT NULL GROUP BY 1, 2""", "gmap"))
def group_iou(spark, sf_dir):
    n = gmap(spark, sf_dir).withColumn("n", F.lead("g").over(Window.partitionBy("y", "x").orderBy("frame"))).where("n is not null")
    n = n.select("*", F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    a, b = F.col("g") == F.col("k"), F.col("n") == F.col("k")
    return n.groupBy("frame", "k").agg(F.round(F.count_if(a & b) / F.nullif(F.count_if(a | b), F.lit(0)), 6).alias("iou"), F.round(F.count_if(a != b) / F.count("*"), 6).alias("xor"))


@query("limb_ratio", with_views("""
a AS (SELECT frame, count(*) FILTER (WHERE g IN (2, 3)) AS n FROM gmap GROUP BY 1)
SELECT frame, round(coalesce(n / nullif(lag(n) OVER (ORDER BY frame), 0), 1), 6) AS ratio FROM a""", "gmap"))
def limb_ratio(spark, sf_dir):
    a = gmap(spark, sf_dir).groupBy("frame").agg(F.count_if(F.col("g").isin(2, 3)).alias("n"))
    return a.select("frame", F.round(F.coalesce(F.col("n") / F.nullif(F.lag("n").over(Window.orderBy("frame")), F.lit(0)), F.lit(1.0)), 6).alias("ratio"))  # a row a frame


@query("warp_error", with_views("""
w AS (SELECT a.frame, a.y, a.x, a.d, b.d AS there FROM depth a JOIN depth b ON b.frame = a.frame + 1 AND b.y = a.y AND b.x = (a.x + 1) % 16)
SELECT frame, round(avg(abs(there - d)), 4) AS error, round(avg((abs(there - d) > 100)::INT), 6) AS inconsistent FROM w GROUP BY 1""", "depth"))
def warp_error(spark, sf_dir):
    """Difference to the next frame under a motion of one cell to the right."""
    d = depth(spark, sf_dir)
    there = d.select((F.col("frame") - 1).alias("frame"), "y", ((F.col("x") + WIDTH - 1) % WIDTH).alias("x"), F.col("d").alias("there"))
    far = F.abs(F.col("there") - F.col("d"))
    return d.join(there, ["frame", "y", "x"]).groupBy("frame").agg(F.round(F.avg(far), 4).alias("error"), F.round(F.avg((far > 100).cast("int")), 6).alias("inconsistent"))


@query("clip_thresholds", with_views("""
g AS (SELECT a.frame, b.d - a.d AS m FROM depth a JOIN depth b ON b.frame = a.frame AND b.y = a.y AND b.x = a.x + 1)
SELECT round(greatest(quantile_cont(abs(m), 0.95), 20), 6) AS t_high, round(quantile_cont(abs(m), 0.9), 6) AS t_low, count(*) AS n FROM g""", "depth"))
def clip_thresholds(spark, sf_dir):
    """Percentiles over a whole clip, which every frame then uses, and the floor below which the upper one may not fall."""
    d = depth(spark, sf_dir)
    right = d.select("frame", "y", (F.col("x") - 1).alias("x"), F.col("d").alias("r"))
    m = d.join(right, ["frame", "y", "x"]).select(F.abs(F.col("r") - F.col("d")).alias("m"))
    t = percentiles(m, [], "m", {"t_high": 0.95, "t_low": 0.9})
    return t.select(F.round(F.greatest("t_high", F.lit(20.0)), 6).alias("t_high"), F.round("t_low", 6).alias("t_low"), "n")
