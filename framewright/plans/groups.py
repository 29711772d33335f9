"""Group maps: exact class sums, arg-max with tie rules, and smoothing over time that stops at cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.registry import query
from framewright.sources.views import gmap, px, seq, with_views

CELL = ["frame", "y", "x"]


def kernel_rho(alpha: float) -> float:
    """Ratio of the weights of neighbouring frames for which the middle one weighs ``alpha`` after normalisation."""
    return (1 - alpha) / (1 + alpha)


def kernel_radius(alpha: float, tail: float = 0.01, most: int = 8) -> int:
    """The smallest radius outside of which less than ``tail`` of the weight lies, at most ``most``."""
    rho, r = kernel_rho(alpha), 0
    while rho > 0 and r < most and 2 * rho ** (r + 1) / (1 + rho) >= tail:
        r += 1
    return r


ALPHA, BOIL = 0.7, 0.3
RHO, RADIUS = kernel_rho(ALPHA), kernel_radius(ALPHA)


def smooth(value: str, weight: Column | None, by: list[str], order: str, rho: float, radius: int) -> tuple[Column, Column]:
    """Weighted sum and total weight over the frames within ``radius``, in a window that ends with the partition."""
    w = Window.partitionBy(*by).orderBy(order)
    q = F.lit(1.0) if weight is None else weight
    total, mass = F.lit(0.0), F.lit(0.0)
    for d in range(-radius, radius + 1):
        there = F.lag(F.col(value), -d).over(w).isNotNull()
        part = F.when(there, F.lit(rho ** abs(d)) * F.lag(q, -d).over(w)).otherwise(0.0)
        total, mass = total + part * F.coalesce(F.lag(F.col(value), -d).over(w).cast("double"), F.lit(0.0)), mass + part
    return total, mass


def argmax(sums: DataFrame, score: str, by: list[str], prefer: Column | None = None) -> DataFrame:
    """The group of the largest score, with ``tied``: of equal ones ``prefer`` if it is among them, else the smallest id."""
    first = F.lit(0) if prefer is None else (F.col("g") == prefer).cast("int")
    top = sums.withColumn("first", first).groupBy(*by).agg(F.max(F.struct(score, "first", (-F.col("g")).alias("g"))).alias("b"), F.array_sort(F.collect_list(score)).alias("all"))
    return top.select(*by, (-F.col("b.g")).cast("int").alias("g"), (F.get("all", F.size("all") - 2) == F.col(f"b.{score}")).alias("tied"))


@query("group_sums", with_views("SELECT frame, y, x, g, s FROM px WHERE s > 0", "px"))
def group_sums(spark, sf_dir):
    return px(spark, sf_dir).where("s > 0")


@query("group_argmax_ties", with_views("""
ranked AS (SELECT frame, y, x, g, row_number() OVER (PARTITION BY frame, y, x ORDER BY s // 20 DESC, g = (y + x) % 4 DESC, g) AS r, count(*) OVER (PARTITION BY frame, y, x, s // 20) AS same FROM px)
SELECT frame, y, x, g, same > 1 AS tied FROM ranked WHERE r = 1""", "px"))
def group_argmax_ties(spark, sf_dir):
    coarse = px(spark, sf_dir).withColumn("s", F.floor(F.col("s") / 20))
    return argmax(coarse, "s", CELL, (F.col("y") + F.col("x")) % 4)


_SMOOTHED = f"""
pairs AS (SELECT a.frame, a.y, a.x, a.g, a.s, sum({RHO!r}::DOUBLE ** abs(b.frame - a.frame) * b.s) AS n, sum({RHO!r}::DOUBLE ** abs(b.frame - a.frame)) AS m
          FROM px a JOIN px b ON a.y = b.y AND a.x = b.x AND a.g = b.g AND b.frame BETWEEN a.frame - {RADIUS} AND a.frame + {RADIUS} GROUP BY ALL),
smoothed AS (SELECT frame, y, x, g, round({1 - BOIL} * (n / m) + {BOIL} * s, 6) AS p FROM pairs)"""


def smoothed(spark, sf_dir) -> DataFrame:
    n, m = smooth("s", None, ["y", "x", "g"], "frame", RHO, RADIUS)
    return px(spark, sf_dir).select(*CELL, "g", F.round((1 - BOIL) * (n / m) + BOIL * F.col("s"), 6).alias("p"))


@query("temporal_group_area", with_views(_SMOOTHED.strip() + """,
best AS (SELECT frame, g, row_number() OVER (PARTITION BY frame, y, x ORDER BY p DESC, g) AS r FROM smoothed)
SELECT frame, g, count(*) AS area FROM best WHERE r = 1 GROUP BY ALL""", "px"))
def temporal_group_area(spark, sf_dir):
    return argmax(smoothed(spark, sf_dir), "p", CELL).groupBy("frame", "g").agg(F.count("*").alias("area"))


@query("temporal_groups", with_views(_SMOOTHED.strip() + "\nSELECT frame, y, x, g, p FROM smoothed", "px"))
def temporal_groups(spark, sf_dir):
    return smoothed(spark, sf_dir)


_SHOTS = """
cuts AS (SELECT clip, i, v, CASE WHEN k = 'error' THEN 0.25 ELSE 1.0 END::DOUBLE AS q, CASE WHEN i > 0 AND abs(v - lag(v) OVER (PARTITION BY clip ORDER BY i)) / 255 > 1 THEN 1 ELSE 0 END AS cut FROM seq),
shots AS (SELECT *, sum(cut) OVER (PARTITION BY clip ORDER BY i)::INT AS shot FROM cuts)"""


def shots(spark, sf_dir) -> DataFrame:
    """Clips with their shots: a cut lies before a frame that differs by more than the threshold from the one before."""
    by = Window.partitionBy("clip").orderBy("i")
    cut = F.coalesce((F.abs(F.col("v") - F.lag("v").over(by)) / 255 > 1).cast("int"), F.lit(0))
    return seq(spark, sf_dir).withColumn("cut", cut).withColumn("shot", F.sum("cut").over(by).cast("int")).withColumn("q", F.when(F.col("k") == "error", 0.25).otherwise(1.0))


@query("kernel_qc_weighted", with_views(_SHOTS.strip() + f""",
w AS (SELECT a.clip, a.i, a.v, sum({RHO!r}::DOUBLE ** abs(a.i - b.i) * b.q * b.v) AS n, sum({RHO!r}::DOUBLE ** abs(a.i - b.i) * b.q) AS m FROM shots a JOIN shots b ON a.clip = b.clip AND a.shot = b.shot AND b.i BETWEEN a.i - {RADIUS} AND a.i + {RADIUS} GROUP BY ALL)
SELECT clip, i, round(CASE WHEN m < 1e-6 THEN v ELSE n / m END, 6) AS v FROM w""", "seq"))
def kernel_qc_weighted(spark, sf_dir):
    n, m = smooth("v", F.col("q"), ["clip", "shot"], "i", RHO, RADIUS)
    return shots(spark, sf_dir).select("clip", "i", F.round(F.when(m < 1e-6, F.col("v")).otherwise(n / m), 6).alias("v"))


@query("kernel_weights", with_views(_SHOTS.strip() + f"""
SELECT a.clip, a.i AS t, b.i AS k, round({RHO!r}::DOUBLE ** abs(a.i - b.i) * b.q, 9) AS w FROM shots a JOIN shots b ON a.clip = b.clip AND a.shot = b.shot AND b.i BETWEEN a.i - {RADIUS} AND a.i + {RADIUS}""", "seq"))
def kernel_weights(spark, sf_dir):
    near = Window.partitionBy("clip", "shot").orderBy("i").rangeBetween(-RADIUS, RADIUS)
    s = shots(spark, sf_dir).withColumn("near", F.collect_list(F.struct("i", "q")).over(near))
    return s.select("clip", F.col("i").alias("t"), F.explode("near").alias("n")).select("clip", "t", F.col("n.i").alias("k"), F.round(F.lit(RHO) ** F.abs(F.col("t") - F.col("n.i")) * F.col("n.q"), 9).alias("w"))


@query("to_background", with_views("SELECT px.frame, px.y, px.x, px.g, CASE WHEN m.g = 2 THEN CASE WHEN px.g = 0 THEN 255 ELSE 0 END ELSE s END AS s FROM px JOIN gmap m USING (frame, y, x)", "px", "gmap"))
def to_background(spark, sf_dir):
    m = gmap(spark, sf_dir).withColumnRenamed("g", "m")
    return px(spark, sf_dir).join(m, CELL).select(*CELL, "g", F.when(F.col("m") == 2, F.when(F.col("g") == 0, 255).otherwise(0)).otherwise(F.col("s")).cast("long").alias("s"))


@query("compose_labels", with_views("""
over AS (SELECT *, row_number() OVER (PARTITION BY frame, y, x ORDER BY s DESC, g) AS r FROM px WHERE g > 0 AND s > 250)
SELECT grid.frame, grid.y, grid.x, coalesce(o.g, 0) AS target FROM grid LEFT JOIN over o ON o.r = 1 AND o.frame = grid.frame AND o.y = grid.y AND o.x = grid.x""", "px"))
def compose_labels(spark, sf_dir):
    over = F.when((F.col("g") > 0) & (F.col("s") > 250), F.struct("s", (-F.col("g")).alias("g")))
    return px(spark, sf_dir).groupBy(*CELL).agg(F.max(over).alias("b")).select(*CELL, F.coalesce(-F.col("b.g"), F.lit(0)).cast("int").alias("target"))


@query("target_status", with_views("""
st AS (SELECT clip, i % 24 AS frame, bool_or(k = 'click') AS hit FROM seq GROUP BY ALL)
SELECT c.clip, f.i::INT AS frame, CASE WHEN hit IS NULL THEN 'no_prompt' WHEN hit THEN 'target' ELSE 'empty' END AS status FROM (SELECT DISTINCT clip FROM seq) c CROSS JOIN range(24) f(i) LEFT JOIN st ON st.clip = c.clip AND st.frame = f.i""", "seq"))
def target_status(spark, sf_dir):
    s = seq(spark, sf_dir)
    hit = s.groupBy("clip", (F.col("i") % 24).alias("frame")).agg(F.bool_or(F.col("k") == "click").alias("hit"))
    frames = s.select("clip").distinct().select("clip", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("frame"))
    return frames.join(hit, ["clip", "frame"], "left").select("clip", "frame", F.when(F.col("hit").isNull(), "no_prompt").when(F.col("hit"), "target").otherwise("empty").alias("status"))


@query("class_group_lut", """
WITH lut(class, g) AS (VALUES ('F-BUILDING', 1), ('HOUSEHOLD', 2), ('MACHINERY', 2), ('BUILDING', 1))
SELECT c_mktsegment AS class, coalesce(any_value(g), 0) AS g, count(*) AS n FROM customer LEFT JOIN lut ON lut.class = c_mktsegment GROUP BY 1""")
def class_group_lut(spark, sf_dir):
    lut = F.create_map(*(F.lit(x) for x in ("F-BUILDING", 1, "HOUSEHOLD", 2, "MACHINERY", 2, "BUILDING", 1)))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.groupBy(F.col("c_mktsegment").alias("class")).agg(F.count("*").alias("n")).select("class", F.coalesce(F.try_element_at(lut, F.col("class")), F.lit(0)).alias("g"), "n")


def mask_of(groups: DataFrame, ids: list[int]) -> DataFrame:
    """(frame, y, x, mask): whether a cell belongs to one of some groups; null groups don't."""
    return groups.select(*CELL, F.coalesce(F.col("g").isin(ids), F.lit(False)).alias("mask"))


@query("groups_mask", with_views("SELECT frame, y, x, g IN (1, 3) AS mask FROM gmap", "gmap"))
def groups_mask(spark, sf_dir):
    return mask_of(gmap(spark, sf_dir), [1, 3])
