"""Statistics of scores: weighted AUC, thresholds, bootstrap intervals, and safety of fields and drawings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.registry import query
from framewright.sources.views import poly, table, with_views

_SCORES = "WITH scores AS (SELECT doc_id, source, n_chars AS s, quality AS y, 1 + doc_id % 3 AS w FROM documents JOIN labels USING (doc_id))\n"


def scores(spark, sf_dir) -> DataFrame:
    """(doc_id, source, s, y, w): a score, a class and a weight for each labelled document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").alias("s"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id").withColumn("w", 1 + F.col("doc_id") % 3)


@query("weighted_auc", _SCORES + """, n AS (SELECT source, s, sum(w) FILTER (WHERE y = 0) AS n, sum(w) FILTER (WHERE y = 1) AS p FROM scores GROUP BY 1, 2),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM n)
SELECT source, round(sum(p * (below + 0.5::DOUBLE * coalesce(n, 0))) / (sum(p) * sum(n)), 6) AS auc FROM c GROUP BY 1""")
def weighted_auc(spark, sf_dir):
    """How likely a positive scores above a negative, ties half, by weight: summed over distinct scores."""
    y, w = F.col("y"), F.col("w")
    n = scores(spark, sf_dir).groupBy("source", "s").agg(F.sum(F.when(y == 0, w)).alias("n"), F.sum(F.when(y == 1, w)).alias("p"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.withColumn("below", below)
    return n.groupBy("source").agg(F.round(F.try_divide(F.sum(F.col("p") * (F.col("below") + 0.5 * F.coalesce("n", F.lit(0)))), F.sum("p") * F.sum("n")), 6).alias("auc"))


@query("retention_threshold", _SCORES + """, c AS (SELECT source, s, sum(w) OVER (PARTITION BY source ORDER BY s DESC) AS cum, sum(w) OVER (PARTITION BY source) AS total FROM scores WHERE y = 1)
SELECT source, max(s) AS tau FROM c WHERE cum >= 0.9 * total GROUP BY 1""")
def retention_threshold(spark, sf_dir):
    """The largest threshold that keeps nine tenths of the positives by weight."""
    by = Window.partitionBy("source")
    each = scores(spark, sf_dir).where("y = 1").groupBy("source", "s").agg(F.sum("w").alias("w"))  # a row for each distinct score
    c = each.withColumn("cum", F.sum("w").over(by.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("w").over(by))
    return c.where(F.col("cum") >= 0.9 * F.col("total")).groupBy("source").agg(F.max("s").alias("tau"))


def bootstrap_sums(rows: DataFrame, stratum: str, track: str, num: Column, den: Column, reps: int = 2000, seed: int = 0) -> DataFrame:
    """(stratum, rep, num, den): sums over ``reps`` resamplings of whole tracks within each stratum.

    A track is drawn a Poisson(1) number of times, from a generator keyed by seed, stratum and track,
    so that the result doesn't depend on the partitioning. Rows are summed by track first; each task
    adds its tracks up in one matrix and reports a row for each stratum and resampling.
    """
    tracks = rows.groupBy(F.col(stratum).cast("string").alias("stratum"), F.xxhash64(F.lit(seed), stratum, track).alias("key"), F.col(track).alias("track")).agg(F.sum(num).cast("double").alias("num"), F.sum(den).cast("double").alias("den"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, key, x, y in zip(*(batch.column(c).to_pylist() for c in ("stratum", "key", "num", "den")), strict=True):
                times = draws(key, reps)
                own = sums.setdefault(name, np.zeros((2, reps)))
                own[0] += times * (x or 0.0)
                own[1] += times * (y or 0.0)
        for name, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * reps, pa.string()), pa.array(np.arange(reps, dtype=np.int32)), pa.array(own[0]), pa.array(own[1])], ["stratum", "rep", "num", "den"])

    return tracks.select("stratum", "key", "num", "den").mapInArrow(run, "stratum string, rep int, num double, den double").groupBy("stratum", "rep").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))


def draws(key: int, reps: int) -> np.ndarray:
    """How often the track of this key is drawn in each resampling."""
    return np.random.Generator(np.random.Philox(key=key % (1 << 64))).poisson(1.0, reps)


@query("bootstrap_interval")
def bootstrap_interval(spark, sf_dir):
    """Interval of the weighted share of positives by source: 2,000 resamplings of tracks of four documents."""
    w = F.col("w")
    sums = bootstrap_sums(scores(spark, sf_dir).withColumn("track", F.floor(F.col("doc_id") / 4)), "source", "track", w * F.col("y"), w)
    share = sums.where("den > 0").withColumn("share", F.col("num") / F.col("den"))
    return share.groupBy(F.col("stratum").alias("source")).agg(F.round(F.percentile("share", 0.025), 6).alias("lo"), F.round(F.percentile("share", 0.975), 6).alias("hi"))


@query("removed_share", _SCORES + "SELECT source, round(sum(w) FILTER (WHERE s < 1000) / sum(w), 6) AS removed, round(sum(w) FILTER (WHERE s >= 1000 AND y = 1) / sum(w) FILTER (WHERE y = 1), 6) AS kept FROM scores GROUP BY 1")
def removed_share(spark, sf_dir):
    w = F.col("w")
    part = lambda test: F.sum(F.when(test, w))
    return scores(spark, sf_dir).groupBy("source").agg(F.round(part(F.col("s") < 1000) / F.sum(w), 6).alias("removed"), F.round(F.try_divide(part((F.col("s") >= 1000) & (F.col("y") == 1)), part(F.col("y") == 1)), 6).alias("kept"))


_SEG = "seg AS (SELECT a.stroke, a.frame, a.j, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS qy FROM poly a JOIN poly b ON b.stroke = a.stroke AND b.j = a.j + 1)"


@query("segment_crossings", with_views(_SEG + """,
o AS (SELECT s.stroke, s.j AS j1, t.j AS j2, (s.bx - s.ax) * (t.ay - s.ay) - (s.qy - s.ay) * (t.ax - s.ax) AS o1, (s.bx - s.ax) * (t.qy - s.ay) - (s.qy - s.ay) * (t.bx - s.ax) AS o2,
  (t.bx - t.ax) * (s.ay - t.ay) - (t.qy - t.ay) * (s.ax - t.ax) AS o3, (t.bx - t.ax) * (s.qy - t.ay) - (t.qy - t.ay) * (s.bx - t.ax) AS o4 FROM seg s JOIN seg t ON t.stroke = s.stroke AND t.j > s.j + 1)
SELECT stroke, count(*) FILTER (WHERE sign(o1) * sign(o2) < 0 AND sign(o3) * sign(o4) < 0) AS crossings FROM o GROUP BY 1""", "poly"))
def segment_crossings(spark, sf_dir):
    """How often the pieces of a stroke cross each other, neighbours aside. All pairs, inside the stroke's row."""
    from framewright.plans.polyline import N, at, strokes

    def side(a, b, c):
        return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))

    def meet(i, k):
        a, b, c, d = at("p", i), at("p", i + 1), at("p", k), at("p", k + 1)
        return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)

    later = F.transform(F.sequence(F.lit(0), F.lit(N - 4)), lambda i: F.size(F.filter(F.sequence(i + 2, F.lit(N - 2)), lambda k: meet(i, k))))
    return strokes(spark, sf_dir).select("stroke", F.aggregate(later, F.lit(0), lambda s, n: s + n).cast("long").alias("crossings"))


@query("jacobian", with_views("""
f AS (SELECT frame, y, x, d / 1000 AS u FROM depth)
SELECT a.frame, round(min((1 + 0.001 * (b.u - a.u)) * (1 + 0.001 * (c.u - a.u))), 9) AS least, count(*) AS n FROM f a JOIN f b ON b.frame = a.frame AND b.y = a.y AND b.x = a.x + 1 JOIN f c ON c.frame = a.frame AND c.y = a.y + 1 AND c.x = a.x GROUP BY 1""", "depth"))
def jacobian(spark, sf_dir):
    """Least determinant of a displacement field by finite differences: above 0 nothing folds over."""
    from framewright.sources.views import depth

    f = depth(spark, sf_dir).withColumn("u", F.col("d") / 1000)
    right = f.select("frame", "y", (F.col("x") - 1).alias("x"), F.col("u").alias("r"))
    down = f.select("frame", (F.col("y") - 1).alias("y"), "x", F.col("u").alias("w"))
    j = f.join(right, ["frame", "y", "x"]).join(down, ["frame", "y", "x"])
    return j.groupBy("frame").agg(F.round(F.min((1 + 0.001 * (F.col("r") - F.col("u"))) * (1 + 0.001 * (F.col("w") - F.col("u")))), 9).alias("least"), F.count("*").alias("n"))


@query("displacement_stats", with_views("""
d AS (SELECT frame, sqrt((x - round(x)) * (x - round(x)) + (y - round(y)) * (y - round(y))) AS d FROM poly)
SELECT frame, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.95), 6) AS p95, round(max(d), 6) AS worst FROM d GROUP BY 1""", "poly"))
def displacement_stats(spark, sf_dir):
    dx, dy = F.col("x") - F.round("x"), F.col("y") - F.round("y")
    return poly(spark, sf_dir).withColumn("d", F.sqrt(dx * dx + dy * dy)).groupBy("frame").agg(F.round(F.percentile("d", 0.5), 6).alias("p50"), F.round(F.percentile("d", 0.95), 6).alias("p95"), F.round(F.max("d"), 6).alias("worst"))


@query("end_gaps", with_views("SELECT a.stroke, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS gap FROM poly a JOIN poly b ON b.stroke = a.stroke AND a.j = 0 AND b.j = 31", "poly"))
def end_gaps(spark, sf_dir):
    from framewright.plans.polyline import at, strokes

    a, b = at("p", 0), at("p", 31)
    return strokes(spark, sf_dir).select("stroke", F.round(F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])), 6).alias("gap"))


_SMOOTH = "sha256(k || (sum(round(v)::BIGINT) OVER (PARTITION BY clip ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))::BIGINT) AS sha"


def smoothed(frames: DataFrame, reach: int) -> DataFrame:
    """(clip, i, sha): a fingerprint of each frame's output, which depends on the frames up to ``reach`` away."""
    near = Window.partitionBy("clip").orderBy("i").rowsBetween(-reach, reach)
    return frames.select("clip", "i", F.sha2(F.concat("k", F.sum(F.round("v").cast("long")).over(near).cast("string")).cast("binary"), 256).alias("sha"))


def same_in_window(frames: DataFrame, first: int, last: int, margin: int, reach: int = 2) -> DataFrame:
    """(clip, n, same): does a run over the frames ``first`` to ``last`` and a margin around them give there what the whole run gives?"""
    part = smoothed(frames.where(F.col("i").between(first - margin, last + margin)), reach).where(F.col("i").between(first, last)).withColumnRenamed("sha", "part")
    return part.join(smoothed(frames, reach), ["clip", "i"]).groupBy("clip").agg(F.count("*").alias("n"), F.bool_and(F.col("part") == F.col("sha")).alias("same"))


@query("window_identity", with_views(f"""
w AS (SELECT clip, i, {_SMOOTH} FROM seq WHERE i BETWEEN 3 AND 16), a AS (SELECT clip, i, {_SMOOTH} FROM seq)
SELECT w.clip, count(*) AS n, bool_and(w.sha = a.sha) AS same FROM w JOIN a USING (clip, i) WHERE i BETWEEN 5 AND 14 GROUP BY 1""", "seq"))
def window_identity(spark, sf_dir):
    """Frames 5 to 14, run alone with two frames of margin, are byte for byte what the whole run gives."""
    from framewright.sources.views import seq

    return same_in_window(seq(spark, sf_dir), 5, 14, 2)


@query("coverage_gaps", with_views("""
u AS (SELECT a.stroke, a.j, NOT EXISTS (SELECT 1 FROM poly b WHERE b.frame = a.frame AND b.stroke <> a.stroke AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1) AS bare FROM poly a),
r AS (SELECT stroke, j, j - row_number() OVER (PARTITION BY stroke ORDER BY j) AS isle FROM u WHERE bare)
SELECT stroke, count(*) AS runs, max(n) AS longest, sum(n)::BIGINT AS bare FROM (SELECT stroke, count(*) AS n FROM r GROUP BY stroke, isle) GROUP BY 1""", "poly"))
def coverage_gaps(spark, sf_dir):
    """Runs of points with no other stroke of the frame within one pixel: buckets of one pixel and their neighbours."""
    p = poly(spark, sf_dir)
    cell = lambda c: F.floor(F.col(c))
    wide = p.select("stroke", "j", "frame", "x", "y", F.explode(F.sequence(cell("x") - 1, cell("x") + 1)).alias("cx")).select("*", F.explode(F.sequence(cell("y") - 1, cell("y") + 1)).alias("cy"))
    others = p.select("frame", F.col("stroke").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), cell("x").alias("cx"), cell("y").alias("cy"))
    met = wide.join(others, ["frame", "cx", "cy"]).where((F.col("o") != F.col("stroke")) & (F.abs(F.col("ox") - F.col("x")) <= 1) & (F.abs(F.col("oy") - F.col("y")) <= 1)).select("stroke", "j").distinct()
    bare = p.select("stroke", "j").join(met, ["stroke", "j"], "left_anti")
    bare = bare.withColumn("isle", F.col("j") - F.row_number().over(Window.partitionBy("stroke").orderBy("j")))
    runs = bare.groupBy("stroke", "isle").agg(F.count("*").alias("n"))
    return runs.groupBy("stroke").agg(F.count("*").alias("runs"), F.max("n").alias("longest"), F.sum("n").alias("bare"))
