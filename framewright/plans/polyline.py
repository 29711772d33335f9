"""Strokes as arrays of points: orientation, resampling, splines, outlines and cutting at the frame's edge.

Points stay in one array per stroke wherever an operator needs their order, so nothing is shuffled
that isn't shuffled by the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.registry import query
from framewright.sources.views import poly, with_views

N = 32


def strokes(spark, sf_dir) -> DataFrame:
    """(stroke, type, frame, p): the points of each stroke in order."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("stroke"), (F.col("label") % 4).alias("type"), (F.col("vec_id") % 20).cast("int").alias("frame"), F.col("embedding").cast("array<double>").alias("e"))
    xy = lambda j: F.struct(F.round(F.get("e", j * 2) * 100, 3).alias("x"), F.round(F.get("e", j * 2 + 1) * 100, 3).alias("y"))
    return e.select("stroke", "type", "frame", F.transform(F.sequence(F.lit(0), F.lit(N - 1)), xy).alias("p"))


def at(p: Column | str, i: Column | int) -> Column:
    return F.get(p, F.lit(i) if isinstance(i, int) else i)


def ahead(p: str) -> Column:
    """The points moved on by one, the first after the last."""
    return F.concat(F.slice(p, 2, N), F.slice(p, 1, 1))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def signed(p: str) -> Column:
    """Shoelace area; y grows downwards, so a positive one runs clockwise."""
    return total(F.zip_with(p, ahead(p), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) * 0.5


def lengths(p: str) -> Column:
    """Length of each piece of an open stroke."""
    return F.zip_with(F.slice(p, 1, N - 1), F.slice(p, 2, N - 1), lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))


_NEXT = "nx AS (SELECT a.*, b.x AS bx, b.y AS qy FROM poly a JOIN poly b ON b.stroke = a.stroke AND b.j = (a.j + 1) % 32)"
_AREA = _NEXT + ", area AS (SELECT stroke, 0.5 * sum(x * qy - bx * y) AS a FROM nx GROUP BY 1)"


@query("signed_area", with_views(_AREA + "\nSELECT stroke, round(a, 3) AS area, a > 0 AS clockwise FROM area", "poly"))
def signed_area(spark, sf_dir):
    return strokes(spark, sf_dir).withColumn("a", signed("p")).select("stroke", F.round("a", 3).alias("area"), (F.col("a") > 0).alias("clockwise"))


@query("orient_cyclic", with_views(_AREA + "\nSELECT stroke, CASE WHEN a < 0 THEN 31 - j ELSE j END AS j, x, y FROM poly JOIN area USING (stroke)", "poly"))
def orient_cyclic(spark, sf_dir):
    """Closed strokes turned clockwise."""
    turned = strokes(spark, sf_dir).withColumn("p", F.when(signed("p") < 0, F.reverse("p")).otherwise(F.col("p")))
    return turned.select("stroke", F.posexplode("p").alias("j", "q")).select("stroke", "j", "q.x", "q.y")


@query("pca_axis", with_views("""
c AS (SELECT stroke, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM poly GROUP BY 1),
t AS (SELECT stroke, 0.5 * atan2(2 * b, a - c) AS t FROM c)
SELECT stroke, round(CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN cos(t) * sign(cos(t)) ELSE cos(t) * sign(sin(t)) END, 5) AS ax, round(CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN sin(t) * sign(cos(t)) ELSE sin(t) * sign(sin(t)) END, 5) AS ay FROM t""", "poly"))
def pca_axis(spark, sf_dir):
    """The main axis, its larger component positive: the closed form for two dimensions."""
    c = poly(spark, sf_dir).groupBy("stroke").agg(F.var_pop("x").alias("a"), F.covar_pop("x", "y").alias("b"), F.var_pop("y").alias("c"))
    t = 0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("c"))
    sign = F.when(F.abs(F.cos(t)) >= F.abs(F.sin(t)), F.signum(F.cos(t))).otherwise(F.signum(F.sin(t)))
    return c.select("stroke", F.round(F.cos(t) * sign, 5).alias("ax"), F.round(F.sin(t) * sign, 5).alias("ay"))


@query("is_loop", with_views("SELECT stroke, round(max(x) FILTER (WHERE j = 0)) = round(max(x) FILTER (WHERE j = 31)) AND count(*) > 3 AS loop FROM poly GROUP BY 1", "poly"))
def is_loop(spark, sf_dir):
    return strokes(spark, sf_dir).select("stroke", ((F.round(at("p", 0)["x"]) == F.round(at("p", N - 1)["x"])) & (F.size("p") > 3)).alias("loop"))


@query("stroke_length", with_views("d AS (SELECT stroke, j, sqrt((bx - x) * (bx - x) + (qy - y) * (qy - y)) AS d FROM (" + "SELECT a.*, b.x AS bx, b.y AS qy FROM poly a JOIN poly b ON b.stroke = a.stroke AND b.j = (a.j + 1) % 32" + "))\nSELECT stroke, round(sum(d) FILTER (WHERE j < 31), 4) AS length, round(sum(d), 4) AS closed FROM d GROUP BY 1", "poly"))
def stroke_length(spark, sf_dir):
    close = F.sqrt((at("p", 0)["x"] - at("p", N - 1)["x"]) * (at("p", 0)["x"] - at("p", N - 1)["x"]) + (at("p", 0)["y"] - at("p", N - 1)["y"]) * (at("p", 0)["y"] - at("p", N - 1)["y"]))
    s = strokes(spark, sf_dir).withColumn("l", total(lengths("p")))
    return s.select("stroke", F.round("l", 4).alias("length"), F.round(F.col("l") + close, 4).alias("closed"))


_ARC = """
d AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS d FROM poly WINDOW w AS (PARTITION BY stroke ORDER BY j)),
arc AS (SELECT *, sum(d) OVER (PARTITION BY stroke ORDER BY j) AS s, sum(d) OVER (PARTITION BY stroke) AS len FROM d)"""


def with_arc(df: DataFrame) -> DataFrame:
    """Adds ``s``: the distance along the stroke at each point."""
    run = F.aggregate(lengths("p"), F.array(F.lit(0.0)), lambda acc, d: F.concat(acc, F.array(F.element_at(acc, -1) + d)))
    return df.withColumn("s", run)


def interpolated(t: Column) -> Column:
    """The point at distance t: the last known one before it and the next, in proportion."""
    k = F.greatest(F.lit(1), F.least(F.size(F.filter("s", lambda s: s <= t)), F.lit(N - 1)))
    a, b, sa, sb = at("p", k - 1), at("p", k), at("s", k - 1), at("s", k)
    u = F.when(sb > sa, (t - sa) / F.when(sb > sa, sb - sa)).otherwise(0.0)
    return F.struct((a["x"] + u * (b["x"] - a["x"])).alias("x"), (a["y"] + u * (b["y"] - a["y"])).alias("y"))


@query("arc_resample", with_views(_ARC.strip() + """,
t AS (SELECT stroke, max(len) AS len, k.i::INT AS k, max(len) * (k.i / 16.0::DOUBLE) AS t FROM arc CROSS JOIN range(17) k(i) GROUP BY stroke, k.i),
seg AS (SELECT t.stroke, t.k, t.t, max(a.j) FILTER (WHERE a.s <= t.t) AS j FROM t JOIN arc a USING (stroke) GROUP BY 1, 2, 3)
SELECT seg.stroke, seg.k, round(a.x + CASE WHEN b.s > a.s THEN (t - a.s) / (b.s - a.s) ELSE 0 END * (b.x - a.x), 3) AS x, round(a.y + CASE WHEN b.s > a.s THEN (t - a.s) / (b.s - a.s) ELSE 0 END * (b.y - a.y), 3) AS y
FROM seg JOIN arc a ON a.stroke = seg.stroke AND a.j = least(seg.j, 30) JOIN arc b ON b.stroke = a.stroke AND b.j = a.j + 1""", "poly"))
def arc_resample(spark, sf_dir):
    """Seventeen points at equal distances along each stroke."""
    s = with_arc(strokes(spark, sf_dir))
    q = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda k: interpolated(F.element_at("s", -1) * (k / 16.0)))
    return s.select("stroke", F.posexplode(q).alias("k", "q")).select("stroke", "k", F.round("q.x", 3).alias("x"), F.round("q.y", 3).alias("y"))


@query("hermite_spline", with_views("""
pt AS (SELECT a.stroke, a.j, a.x, a.y, b.x AS bx, b.y AS qy, 0.5 * (b.x - coalesce(z.x, a.x)) AS mx, 0.5 * (b.y - coalesce(z.y, a.y)) AS my, 0.5 * (coalesce(c.x, b.x) - a.x) AS nx, 0.5 * (coalesce(c.y, b.y) - a.y) AS ny
  FROM poly a JOIN poly b ON b.stroke = a.stroke AND b.j = a.j + 1 LEFT JOIN poly z ON z.stroke = a.stroke AND z.j = a.j - 1 LEFT JOIN poly c ON c.stroke = a.stroke AND c.j = a.j + 2),
t AS (SELECT i::INT AS k, i / 4.0::DOUBLE AS t FROM range(4) r(i))
SELECT stroke, j * 4 + k AS k, round((2*t*t*t - 3*t*t + 1) * x + (t*t*t - 2*t*t + t) * mx + (3*t*t - 2*t*t*t) * bx + (t*t*t - t*t) * nx, 10) AS x, round((2*t*t*t - 3*t*t + 1) * y + (t*t*t - 2*t*t + t) * my + (3*t*t - 2*t*t*t) * qy + (t*t*t - t*t) * ny, 10) AS y FROM pt CROSS JOIN t""", "poly"))
def hermite_spline(spark, sf_dir):
    """Cardinal spline of tension one half with four steps a piece, end points doubled."""
    def piece(i: Column) -> Column:
        a, b = at("p", i), at("p", i + 1)
        z, c = F.coalesce(at("p", F.when(i > 0, i - 1)), a), F.coalesce(at("p", i + 2), b)

        def point(k: Column) -> Column:
            t = k / 4.0
            w = (2 * t * t * t - 3 * t * t + 1, t * t * t - 2 * t * t + t, 3 * t * t - 2 * t * t * t, t * t * t - t * t)
            f = lambda n: F.round(w[0] * a[n] + w[1] * (0.5 * (b[n] - z[n])) + w[2] * b[n] + w[3] * (0.5 * (c[n] - a[n])), 10)
            return F.struct((i * 4 + k).alias("k"), f("x").alias("x"), f("y").alias("y"))

        return F.transform(F.sequence(F.lit(0), F.lit(3)), point)

    out = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(N - 2)), piece))
    return strokes(spark, sf_dir).select("stroke", F.inline(out))


@query("taper", with_views(_ARC.strip() + ",\nu AS (SELECT stroke, j, least(1, greatest(0, least(s, len - s) / least(30.0::DOUBLE, len / 2))) AS u FROM arc)\nSELECT stroke, j, round(u * u * (3 - 2 * u), 5) AS w FROM u", "poly"))
def taper(spark, sf_dir):
    """Width factor that rises smoothly from either free end."""
    def factor(s: Column) -> Column:
        u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least(s, F.element_at("s", -1) - s) / F.least(F.lit(30.0), F.element_at("s", -1) / 2)))
        return F.round(u * u * (3 - 2 * u), 5)

    return with_arc(strokes(spark, sf_dir)).select("stroke", F.posexplode(F.transform("s", factor)).alias("j", "w"))


@query("edge_fade", with_views("d AS (SELECT stroke, j, least(1, greatest(0, (least(x + 50, 50 - x, 50 - y) - 2) / 20)) AS u FROM poly)\nSELECT stroke, j, round(u * u * (3 - 2 * u), 6) AS fade FROM d", "poly"))
def edge_fade(spark, sf_dir):
    u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.least(F.col("x") + 50, 50 - F.col("x"), 50 - F.col("y")) - 2) / 20))
    return poly(spark, sf_dir).withColumn("u", u).select("stroke", "j", F.round(F.col("u") * F.col("u") * (3 - 2 * F.col("u")), 6).alias("fade"))


@query("width_profile", with_views(_ARC.strip() + ",\nu AS (SELECT stroke, j, least(1, greatest(0, least(s, len - s) / least(30.0::DOUBLE, len / 2))) AS u FROM arc)\nSELECT stroke, j, round(greatest(0.6, 3 * (u * u * (3 - 2 * u))), 4) AS width FROM u", "poly"))
def width_profile(spark, sf_dir):
    rise = lambda s: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least(s, F.element_at("s", -1) - s) / F.least(F.lit(30.0), F.element_at("s", -1) / 2)))
    return with_arc(strokes(spark, sf_dir)).select("stroke", F.posexplode(F.transform("s", lambda s: F.round(F.greatest(F.lit(0.6), 3 * _smooth(rise(s))), 4))).alias("j", "width"))


def _smooth(u: Column) -> Column:
    return u * u * (3 - 2 * u)


_ON = "e AS (SELECT stroke, j, x, y, abs(x) > 12 OR y > 12 AS edge FROM poly)"


@query("edge_runs", with_views(_ON + """,
f AS (SELECT *, CASE WHEN edge = lag(edge) OVER (PARTITION BY stroke ORDER BY j) THEN 0 ELSE 1 END AS b FROM e), r AS (SELECT *, sum(b) OVER (PARTITION BY stroke ORDER BY j) AS run FROM f)
SELECT stroke, greatest(min(j) - 1, 0) AS lo, least(max(j) + 1, 31) AS hi, min(j) > 0 AS starts_on_edge, max(j) < 31 AS ends_on_edge FROM r WHERE NOT edge GROUP BY stroke, run""", "poly"))
def edge_runs(spark, sf_dir):
    """Open strokes cut into the pieces off the frame's edge, each with the crossing points at its ends."""
    edge = F.transform("p", lambda q: (F.abs(q["x"]) > 12) | (q["y"] > 12))
    s = strokes(spark, sf_dir).withColumn("edge", edge)
    starts = F.filter(F.sequence(F.lit(0), F.lit(N - 1)), lambda i: ~F.get("edge", i) & F.coalesce(F.get("edge", F.when(i > 0, i - 1)), F.lit(True)))
    s = s.select("stroke", "edge", F.explode(starts).alias("a"))
    stop = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.lit(N - 1)), lambda i: (i > F.col("a")) & F.get("edge", i))), F.lit(N)) - 1
    s = s.withColumn("b", stop)
    return s.select("stroke", F.greatest(F.col("a") - 1, F.lit(0)).alias("lo"), F.least(F.col("b") + 1, F.lit(N - 1)).alias("hi"), (F.col("a") > 0).alias("starts_on_edge"), (F.col("b") < N - 1).alias("ends_on_edge"))


@query("edge_sides", with_views("SELECT stroke, j, concat_ws(',', CASE WHEN y > 12 THEN 'bottom' END, CASE WHEN x < -12 THEN 'left' END, CASE WHEN x > 12 THEN 'right' END) AS sides FROM poly", "poly"))
def edge_sides(spark, sf_dir):
    return poly(spark, sf_dir).select("stroke", "j", F.concat_ws(",", F.when(F.col("y") > 12, "bottom"), F.when(F.col("x") < -12, "left"), F.when(F.col("x") > 12, "right")).alias("sides"))


@query("extension", with_views("""
t AS (SELECT a.stroke, b.x, b.y, b.x - a.x AS dx, b.y - a.y AS dy FROM poly a JOIN poly b ON b.stroke = a.stroke AND a.j = 30 AND b.j = 31), u AS (SELECT *, sqrt(dx * dx + dy * dy) AS n FROM t)
SELECT stroke, round(CASE WHEN n > 0 AND abs(dy / n) >= sin(radians(45)) THEN x + dx / n * 6 ELSE x END, 4) AS x, round(CASE WHEN n > 0 AND abs(dy / n) >= sin(radians(45)) THEN y + dy / n * 6 ELSE y + 6 END, 4) AS y FROM u""", "poly"))
def extension(spark, sf_dir):
    """The end drawn on past the bottom edge: along the tangent, or straight down where it meets the edge too flatly."""
    a, b = at("p", N - 2), at("p", N - 1)
    s = strokes(spark, sf_dir).select("stroke", b["x"].alias("x"), b["y"].alias("y"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy")).withColumn("n", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    n = F.when(F.col("n") > 0, F.col("n"))
    steep = F.coalesce(F.abs(F.col("dy") / n) >= F.sin(F.radians(F.lit(45.0))), F.lit(False))
    return s.select("stroke", F.round(F.when(steep, F.col("x") + F.col("dx") / n * 6).otherwise(F.col("x")), 4).alias("x"), F.round(F.when(steep, F.col("y") + F.col("dy") / n * 6).otherwise(F.col("y") + 6), 4).alias("y"))


@query("piece_outline", with_views("""
t AS (SELECT a.stroke, a.j, a.x, a.y, coalesce(c.x, a.x) - coalesce(z.x, a.x) AS dx, coalesce(c.y, a.y) - coalesce(z.y, a.y) AS dy FROM poly a LEFT JOIN poly z ON z.stroke = a.stroke AND z.j = a.j - 1 LEFT JOIN poly c ON c.stroke = a.stroke AND c.j = a.j + 1),
n AS (SELECT *, sqrt(dx * dx + dy * dy) AS n FROM t)
SELECT stroke, j AS k, round(x - dy / n * 1.5, 3) AS x, round(y + dx / n * 1.5, 3) AS y FROM n WHERE n > 0 UNION ALL SELECT stroke, 63 - j, round(x + dy / n * 1.5, 3), round(y - dx / n * 1.5, 3) FROM n WHERE n > 0""", "poly"))
def piece_outline(spark, sf_dir):
    """Both sides of a stroke of width three: down one side, back along the other."""
    def sides(q: Column, i: Column) -> Column:
        z, c = F.coalesce(at("p", F.when(i > 0, i - 1)), q), F.coalesce(at("p", i + 1), q)
        dx, dy = c["x"] - z["x"], c["y"] - z["y"]
        n = F.sqrt(dx * dx + dy * dy)
        n = F.when(n > 0, n)
        one = lambda k, s: F.struct(k.alias("k"), F.round(q["x"] - s * dy / n * 1.5, 3).alias("x"), F.round(q["y"] + s * dx / n * 1.5, 3).alias("y"))
        return F.array(one(i, F.lit(1.0)), one(2 * N - 1 - i, F.lit(-1.0)))

    return strokes(spark, sf_dir).select("stroke", F.inline(F.flatten(F.transform("p", sides)))).where("x is not null")


@query("stroke_order", with_views("""
k AS (SELECT stroke, any_value(frame) AS frame, any_value(type) AS type, min(y) AS top, arg_min(x, (y, x)) AS topx FROM poly GROUP BY 1)
SELECT frame, stroke, row_number() OVER (PARTITION BY frame ORDER BY type, top, topx, stroke) - 1 AS rank FROM k""", "poly"))
def stroke_order(spark, sf_dir):
    """A frame's strokes in a total order: kind, highest point, then points."""
    from pyspark.sql import Window

    top = F.array_min(F.transform("p", lambda q: F.struct(q["y"].alias("y"), q["x"].alias("x"))))
    s = strokes(spark, sf_dir).withColumn("top", top)
    return s.select("frame", "stroke", (F.row_number().over(Window.partitionBy("frame").orderBy("type", "top", "stroke")) - 1).cast("long").alias("rank"))


@query("top_point", with_views("SELECT stroke, arg_min(j, (y, x, j)) AS j FROM poly GROUP BY 1", "poly"))
def top_point(spark, sf_dir):
    return strokes(spark, sf_dir).select("stroke", F.array_min(F.transform("p", lambda q, j: F.struct(q["y"].alias("y"), q["x"].alias("x"), j.alias("j"))))["j"].alias("j"))


@query("normalize_start", with_views("t AS (SELECT stroke, arg_min(j, (y, x, j)) AS t FROM poly GROUP BY 1)\nSELECT stroke, (j - t + 32) % 32 AS j, x, y FROM poly JOIN t USING (stroke)", "poly"))
def normalize_start(spark, sf_dir):
    """Closed strokes turned so that they start at their highest point."""
    t = F.array_min(F.transform("p", lambda q, j: F.struct(q["y"].alias("y"), q["x"].alias("x"), j.alias("j"))))["j"]
    s = strokes(spark, sf_dir).withColumn("t", t)
    return s.select("stroke", F.posexplode(F.concat(F.slice("p", F.col("t") + 1, F.lit(N)), F.slice("p", F.lit(1), F.col("t")))).alias("j", "q")).select("stroke", "j", "q.x", "q.y")


_WEIGHTS = [round(2.718281828459045 ** (-(k * k) / 8), 9) for k in range(5)]


@query("smooth_closed", with_views(f"""
w(d, w) AS (VALUES {', '.join(f'({d}, {_WEIGHTS[abs(d)]})' for d in range(-4, 5))})
SELECT a.stroke, a.j, round(sum(w::DOUBLE * b.x) / sum(w::DOUBLE), 4) AS x, round(sum(w::DOUBLE * b.y) / sum(w::DOUBLE), 4) AS y FROM poly a CROSS JOIN w JOIN poly b ON b.stroke = a.stroke AND b.j = (a.j + d + 32) % 32 GROUP BY 1, 2""", "poly"))
def smooth_closed(spark, sf_dir):
    """Gaussian of two samples along a closed stroke."""
    mass = sum(_WEIGHTS[abs(d)] for d in range(-4, 5))

    def mean(j: Column) -> Column:
        f = lambda n: F.round(sum((_WEIGHTS[abs(d)] * at("p", (j + d + N) % N)[n] for d in range(-4, 5)), F.lit(0.0)) / mass, 4)
        return F.struct(f("x").alias("x"), f("y").alias("y"))

    return strokes(spark, sf_dir).select("stroke", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(N - 1)), mean)).alias("j", "q")).select("stroke", "j", "q.x", "q.y")


@query("turn_angles", with_views("""
v AS (SELECT b.stroke, b.j, b.x - a.x AS ax, b.y - a.y AS ay, c.x - b.x AS bx, c.y - b.y AS qy FROM poly b JOIN poly a ON a.stroke = b.stroke AND a.j = b.j - 3 JOIN poly c ON c.stroke = b.stroke AND c.j = b.j + 3),
t AS (SELECT stroke, j, degrees(acos(greatest(-1, least(1, (ax * bx + ay * qy) / greatest(sqrt(ax * ax + ay * ay) * sqrt(bx * bx + qy * qy), 1e-12))))) AS turn FROM v)
SELECT stroke, j, round(turn, 3) AS turn, turn > 60 AND turn >= max(turn) OVER (PARTITION BY stroke ORDER BY j RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS corner FROM t""", "poly"))
def turn_angles(spark, sf_dir):
    """The angle between the ways in and out over three samples; corners are sharp local maxima."""
    def turn(j: Column) -> Column:
        a, b, c = at("p", j - 3), at("p", j), at("p", j + 3)
        ax, ay, bx, qy = b["x"] - a["x"], b["y"] - a["y"], c["x"] - b["x"], c["y"] - b["y"]
        cos = (ax * bx + ay * qy) / F.greatest(F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + qy * qy), F.lit(1e-12))
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))

    s = strokes(spark, sf_dir).withColumn("t", F.transform(F.sequence(F.lit(3), F.lit(N - 4)), turn))
    s = s.select("stroke", "t", F.posexplode_outer("t").alias("k", "turn"))  # t is never empty; without outer a filter on its size is put on the scan, with p built anew for each of its uses
    top = F.array_max(F.slice("t", F.greatest(F.col("k") - 2, F.lit(1)), F.least(F.col("k") + 4, F.lit(N - 6)) - F.greatest(F.col("k") - 3, F.lit(0))))
    return s.select("stroke", (F.col("k") + 3).alias("j"), F.round("turn", 3).alias("turn"), ((F.col("turn") > 60) & (F.col("turn") >= top)).alias("corner"))


def records(s: DataFrame) -> DataFrame:
    """(stroke, json) of (stroke, track, kind, closed, groups, p, strength): fields in a fixed order, no field for what is null.

    Closed strokes have the index of their first point as anchor.
    """
    pairs = F.transform("p", lambda q: F.array(q["x"], q["y"])).alias("points")
    anchor = F.when(F.col("closed"), F.lit(0)).alias("anchor")
    return s.select("stroke", F.to_json(F.struct(F.col("track").alias("track_id"), F.col("kind").alias("type"), "closed", "groups", pairs, anchor, "strength")).alias("json"))


@query("stroke_records", with_views("""
p AS (SELECT stroke, any_value(type) AS type, list([x, y] ORDER BY j) AS points FROM poly GROUP BY 1)
SELECT stroke, stroke + 1 AS track, CASE type WHEN 0 THEN 'silhouette' WHEN 1 THEN 'group_boundary' ELSE 'occlusion' END AS kind, type = 0 AS closed, len(points) AS n, CASE WHEN type = 0 THEN 0 END AS anchor, CASE WHEN type >= 2 THEN 0.5::DOUBLE END AS strength, points[1][1] AS x, points[32][2] AS y FROM p""", "poly"))
def stroke_records(spark, sf_dir):
    """Finished strokes as records, written and read back."""
    kind = F.when(F.col("type") == 0, "silhouette").when(F.col("type") == 1, "group_boundary").otherwise("occlusion")
    s = strokes(spark, sf_dir).select("stroke", (F.col("stroke") + 1).alias("track"), kind.alias("kind"), (F.col("type") == 0).alias("closed"), F.array(F.lit("a")).alias("groups"), "p", F.when(F.col("type") >= 2, 0.5).alias("strength"))
    back = F.from_json("json", "track_id long, type string, closed boolean, groups array<string>, points array<array<double>>, anchor int, strength double").alias("r")
    return records(s).select("stroke", back).select("stroke", F.col("r.track_id").alias("track"), F.col("r.type").alias("kind"), "r.closed", F.size("r.points").cast("long").alias("n"), "r.anchor", "r.strength", F.col("r.points")[0][0].alias("x"), F.col("r.points")[31][1].alias("y"))


@query("simplify")
def simplify(spark, sf_dir):
    """Points kept by recursive splitting at a distance of four."""
    import numpy as np
    import pandas as pd

    from framewright.operators import kernels

    def run(batches):
        for pdf in batches:
            rows = [(s, int(i)) for s, p in zip(pdf.stroke, pdf.p, strict=True) for i in kernels.simplify(np.array([(q["x"], q["y"]) for q in p]), 4.0)]
            yield pd.DataFrame(rows, columns=["stroke", "j"])

    return strokes(spark, sf_dir).select("stroke", "p").mapInPandas(run, "stroke long, j int")
