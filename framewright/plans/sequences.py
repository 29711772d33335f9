"""Sequences of a clip: cuts, shots, runs, shifted windows, records and chains."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.plans.groups import _SHOTS, shots
from framewright.registry import query
from framewright.sources.views import runs, seq, table, with_views


def by_clip():
    """A clip's frames in order."""
    return Window.partitionBy("clip").orderBy("i")


@query("cut_scores", with_views("""
s AS (SELECT clip, i, coalesce(abs(v - lag(v) OVER (PARTITION BY clip ORDER BY i)), 0) / 255 AS score FROM seq)
SELECT clip, i, round(score, 9) AS score, score > 1 AS cut FROM s""", "seq"))
def cut_scores(spark, sf_dir):
    s = seq(spark, sf_dir).withColumn("score", F.coalesce(F.abs(F.col("v") - F.lag("v").over(by_clip())), F.lit(0.0)) / 255)
    return s.select("clip", "i", F.round("score", 9).alias("score"), (F.col("score") > 1).alias("cut"))


@query("shot_bounds", with_views(_SHOTS.strip() + "\nSELECT clip, i, shot, min(i) OVER (PARTITION BY clip, shot) AS lo, max(i) OVER (PARTITION BY clip, shot) AS hi FROM shots", "seq"))
def shot_bounds(spark, sf_dir):
    whole = Window.partitionBy("clip", "shot")
    return shots(spark, sf_dir).select("clip", "i", "shot", F.min("i").over(whole).alias("lo"), F.max("i").over(whole).alias("hi"))


def shifted_bounds(n, i, width: int):
    """Start and end of the window of ``width`` samples around i that is moved, not cut, at either end of n samples."""
    start = F.when(n <= width, 0).otherwise(F.greatest(F.lit(0), F.least(i - (width - 1) // 2, n - width)))
    return start, F.when(n <= width, n).otherwise(start + width)


def shifted_median(df, value: str, width: int):
    """Adds ``med``: the median over the shifted window; only the neighbours that it can reach are held for a row."""
    by = Window.partitionBy("clip")
    near = Window.partitionBy("clip").orderBy("i").rangeBetween(-(width - 1), width - 1)
    start, end = shifted_bounds(F.col("clip_n"), F.col("i"), width)
    df = df.withColumn("clip_n", F.count("*").over(by)).withColumn("near", F.collect_list(value).over(near)).withColumn("low", F.greatest(F.lit(0), F.col("i") - (width - 1)))
    cut = F.array_sort(F.slice("near", (start - F.col("low") + 1).cast("int"), (end - start).cast("int")))
    m = F.size("cut")
    mid = (F.get("cut", ((m - 1) / 2).cast("int")) + F.get("cut", (m / 2).cast("int"))) / 2
    return df.withColumn("cut", cut).withColumn("med", mid).drop("near", "cut", "low", "clip_n")


@query("area_vs_shifted_median", with_views("""
n AS (SELECT clip, count(*)::INT AS n FROM seq GROUP BY 1),
b AS (SELECT clip, i, v, n, CASE WHEN n <= 49 THEN 0 ELSE greatest(0, least(i - 24, n - 49)) END AS s FROM seq JOIN n USING (clip)),
m AS (SELECT b.clip, b.i, b.v, median(o.v) AS med FROM b JOIN seq o ON o.clip = b.clip AND o.i >= b.s AND o.i < CASE WHEN b.n <= 49 THEN b.n ELSE b.s + 49 END GROUP BY ALL)
SELECT clip, i, round(med, 6) AS med, round(CASE WHEN med > 0 THEN v / med END, 6) AS ratio FROM m""", "seq"))
def area_vs_shifted_median(spark, sf_dir):
    s = shifted_median(seq(spark, sf_dir), "v", 49)
    return s.select("clip", "i", F.round("med", 6).alias("med"), F.round(F.when(F.col("med") > 0, F.col("v") / F.col("med")), 6).alias("ratio"))


@query("shifted_windows", with_views("""
n AS (SELECT clip, count(*)::INT AS n FROM seq GROUP BY 1), b AS (SELECT clip, i, n, CASE WHEN n <= 61 THEN 0 ELSE greatest(0, least(i - 30, n - 61)) END AS s FROM seq JOIN n USING (clip))
SELECT clip, i, s AS start, CASE WHEN n <= 61 THEN n ELSE s + 61 END AS "end" FROM b""", "seq"))
def shifted_windows(spark, sf_dir):
    s = seq(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("clip")).cast("int"))
    start, end = shifted_bounds(F.col("n"), F.col("i"), 61)
    return s.select("clip", "i", start.alias("start"), end.alias("end"))


_RLE = """
f AS (SELECT *, CASE WHEN n = lag(n) OVER (PARTITION BY clip ORDER BY i) THEN 0 ELSE 1 END AS b FROM runs),
r AS (SELECT *, sum(b) OVER (PARTITION BY clip ORDER BY i)::INT AS run FROM f),
rle AS (SELECT clip, run, min(i) AS lo, max(i) + 1 AS hi, any_value(n) AS n FROM r GROUP BY ALL)"""


def run_lengths(spark, sf_dir):
    """(clip, run, lo, hi, n): maximal runs of equal values, hi exclusive."""
    s = runs(spark, sf_dir).withColumn("b", F.coalesce((F.col("n") != F.lag("n").over(by_clip())).cast("int"), F.lit(1)))
    return s.withColumn("run", F.sum("b").over(by_clip()).cast("int")).groupBy("clip", "run").agg(F.min("i").alias("lo"), (F.max("i") + 1).alias("hi"), F.first("n").alias("n"))


@query("run_length", with_views(_RLE.strip() + "\nSELECT clip, lo, hi, n FROM rle", "runs"))
def run_length(spark, sf_dir):
    return run_lengths(spark, sf_dir).select("clip", "lo", "hi", "n")


@query("transient_spikes", with_views(_RLE.strip() + """,
l AS (SELECT *, last_value(CASE WHEN hi - lo >= 2 THEN n END IGNORE NULLS) OVER (PARTITION BY clip ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
               first_value(CASE WHEN hi - lo >= 2 THEN n END IGNORE NULLS) OVER (PARTITION BY clip ORDER BY run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM rle)
SELECT clip, lo, hi, n, hi - lo < 2 AND coalesce(n > greatest(p, q), false) AS fails FROM l""", "runs"))
def transient_spikes(spark, sf_dir):
    """A short run fails if its value is above those of the nearest long runs before and after it."""
    held = F.when(F.col("hi") - F.col("lo") >= 2, F.col("n"))
    by = Window.partitionBy("clip").orderBy("run")
    back = Window.partitionBy("clip").orderBy(F.desc("run"))  # a growing frame in either direction
    before = F.last(held, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last(held, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    fails = (F.col("hi") - F.col("lo") < 2) & F.coalesce(F.col("n") > F.greatest(before, after), F.lit(False))
    return run_lengths(spark, sf_dir).select("clip", "lo", "hi", "n", fails.alias("fails"))


@query("big_blob_rules", with_views(_RLE.strip() + """
SELECT r.clip, r.i, r.n > 3 AS legacy, false AS report, rle.hi - rle.lo AS held FROM r JOIN rle USING (clip, run)""", "runs"))
def big_blob_rules(spark, sf_dir):
    rle = run_lengths(spark, sf_dir)
    return rle.select("clip", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("i"), (F.col("n") > 3).alias("legacy"), F.lit(False).alias("report"), (F.col("hi") - F.col("lo")).alias("held"))


@query("index_ranges", with_views("""
p AS (SELECT clip, i, i - row_number() OVER (PARTITION BY clip ORDER BY i) AS isle FROM seq WHERE k IN ('click', 'view'))
SELECT clip, min(i) AS lo, max(i) AS hi FROM p GROUP BY clip, isle""", "seq"))
def index_ranges(spark, sf_dir):
    p = seq(spark, sf_dir).where(F.col("k").isin("click", "view")).withColumn("isle", F.col("i") - F.row_number().over(by_clip()))
    return p.groupBy("clip", "isle").agg(F.min("i").alias("lo"), F.max("i").alias("hi")).drop("isle")


@query("latest_record", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, (ts, event_id)) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY 1, 2")
def latest_record(spark, sf_dir):
    """The last record of each key; appended later wins."""
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("e"))
    return last.select("user_id", "event_type", "e.event_id", "e.value")


@query("frame_window", with_views("SELECT clip, i, v FROM seq WHERE i >= 5 AND i < 15", "seq"))
def frame_window(spark, sf_dir):
    return seq(spark, sf_dir).where("i >= 5 and i < 15").select("clip", "i", "v")


@query("point_frame", with_views("SELECT y, x, g FROM gmap WHERE frame = 7", "gmap"))
def point_frame(spark, sf_dir):
    from framewright.sources.views import gmap

    return gmap(spark, sf_dir).where("frame = 7").select("y", "x", "g")


@query("preview_samples", with_views("n AS (SELECT clip, count(*)::INT AS n FROM seq GROUP BY 1)\nSELECT clip, i, v FROM seq JOIN n USING (clip) WHERE i IN (0, n // 2, n - 1)", "seq"))
def preview_samples(spark, sf_dir):
    s = seq(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("clip")))
    return s.where("i = 0 or i = n div 2 or i = n - 1").select("clip", "i", "v")


@query("frame_list", "SELECT o_orderkey AS clip, i::INT AS i, 'frame_' || lpad(i::VARCHAR, 5, '0') || '.png' AS name FROM (SELECT o_orderkey, unnest(range(3, 3 + (o_custkey % 5))) AS i FROM orders)")
def frame_list(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_custkey % 5 > 0")
    o = o.select(F.col("o_orderkey").alias("clip"), F.explode(F.sequence(F.lit(3), (F.lit(2) + F.col("o_custkey") % 5).cast("int"))).alias("i"))
    return o.withColumn("name", F.format_string("frame_%05d.png", F.col("i")))


@query("trim_frames", """
WITH p AS (SELECT o_orderkey, o_totalprice / 1000 AS sec FROM orders), f AS (SELECT *, ceil(sec * 30 - 1e-6)::BIGINT AS start, ceil((sec + 2.5) * 30 - 1e-6)::BIGINT AS stop FROM p)
SELECT o_orderkey, start, stop, floor(start * 1000.0::DOUBLE / 30) / 1000 AS start_s FROM f""")
def trim_frames(spark, sf_dir):
    """Seconds to the half-open range of frames at 30 a second, and its start as whole milliseconds."""
    p = table(spark, sf_dir, "orders").withColumn("sec", F.col("o_totalprice") / 1000)
    p = p.withColumn("start", F.ceil(F.col("sec") * 30 - 1e-6)).withColumn("stop", F.ceil((F.col("sec") + 2.5) * 30 - 1e-6))
    return p.select("o_orderkey", "start", "stop", (F.floor(F.col("start") * 1000.0 / 30) / 1000).alias("start_s"))


@query("hash_chain", """
WITH h AS (SELECT conv_id, turn, sha256(text) AS sha, CASE WHEN turn % 7 = 5 THEN 'edited' ELSE lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn) END AS prev FROM conversations),
ok AS (SELECT *, prev IS NOT DISTINCT FROM lag(sha) OVER (PARTITION BY conv_id ORDER BY turn) AS link FROM h)
SELECT conv_id, turn, sha, min(link::INT) OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS trusted FROM ok""")
def hash_chain(spark, sf_dir):
    """Each record names the hash of the one before; after the first break nothing is trusted."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    h = table(spark, sf_dir, "conversations").withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    h = h.withColumn("before", F.lag("sha").over(by)).withColumn("prev", F.when(F.col("turn") % 7 == 5, "edited").otherwise(F.col("before")))
    return h.select("conv_id", "turn", "sha", (F.min(F.col("prev").eqNullSafe(F.col("before")).cast("int")).over(by) == 1).alias("trusted"))


_STILL = """
m AS (SELECT clip, i, i > 0 AND abs(v - lag(v) OVER (PARTITION BY clip ORDER BY i)) {cmp} AS ok FROM seq),
p AS (SELECT clip, i, i - row_number() OVER (PARTITION BY clip ORDER BY i) AS isle FROM m WHERE ok)
SELECT clip, min(i) AS lo, max(i) + 1 AS hi FROM p GROUP BY clip, isle HAVING count(*) >= {least}"""


def _windows(spark, sf_dir, test, least):
    m = seq(spark, sf_dir).withColumn("d", F.abs(F.col("v") - F.lag("v").over(by_clip()))).where(test)
    p = m.withColumn("isle", F.col("i") - F.row_number().over(by_clip())).groupBy("clip", "isle")
    return p.agg(F.min("i").alias("lo"), (F.max("i") + 1).alias("hi"), F.count("*").alias("n")).where(F.col("n") >= least).select("clip", "lo", "hi")


@query("static_windows", with_views(_STILL.format(cmp="< 150", least=3), "seq"))
def static_windows(spark, sf_dir):
    return _windows(spark, sf_dir, "d < 150", 3)


@query("fast_windows", with_views(_STILL.format(cmp="> 100", least=2), "seq"))
def fast_windows(spark, sf_dir):
    return _windows(spark, sf_dir, "d > 100", 2)


@query("area_lag", with_views("""
l AS (SELECT unnest(range(-3, 4))::INT AS lag), a AS (SELECT clip, i, v - avg(v) OVER (PARTITION BY clip) AS v FROM seq),
c AS (SELECT x.clip, lag, round(avg(x.v * y.v), 3) AS c FROM l JOIN a x ON true JOIN a y ON y.clip = x.clip AND y.i = x.i + lag AND y.i % 2 >= 0 GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY c DESC, lag) AS r FROM c WHERE lag <> 0)
SELECT t.clip, t.lag, t.c, round(CASE WHEN p.c IS NOT NULL AND n.c IS NOT NULL AND p.c - 2 * t.c + n.c <> 0 THEN t.lag + 0.5 * (p.c - n.c) / (p.c - 2 * t.c + n.c) ELSE t.lag END, 3) AS fine
FROM top t LEFT JOIN c p ON p.clip = t.clip AND p.lag = t.lag - 1 LEFT JOIN c n ON n.clip = t.clip AND n.lag = t.lag + 1 WHERE r = 1""", "seq"))
def area_lag(spark, sf_dir):
    """The lag of the largest correlation of a clip with itself, refined by a parabola through its neighbours."""
    a = seq(spark, sf_dir).withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("clip")))
    means = a.select("clip", *(F.round((F.col("v") * (F.lag("v", -d).over(by_clip()))), 12).alias(f"m{d + 3}") for d in range(-3, 4))).groupBy("clip").agg(*(F.round(F.avg(f"m{k}"), 3).alias(f"c{k}") for k in range(7)))
    c = means.select("clip", F.array(*(F.struct(F.lit(k - 3).alias("lag"), F.col(f"c{k}").alias("c")) for k in range(7))).alias("all"))
    best = F.array_max(F.transform(F.filter("all", lambda s: (s["lag"] != 0) & s["c"].isNotNull()), lambda s: F.struct(s["c"].alias("c"), (-s["lag"]).alias("back"))))
    c = c.withColumn("b", best).withColumn("lag", -F.col("b.back")).withColumn("c", F.col("b.c"))
    near = lambda d: F.get(F.col("all"), F.col("lag") + 3 + d)["c"]
    bend = near(-1) - 2 * F.col("c") + near(1)
    return c.select("clip", "lag", "c", F.round(F.when(bend.isNotNull() & (bend != 0), F.col("lag") + 0.5 * (near(-1) - near(1)) / F.when(bend != 0, bend)).otherwise(F.col("lag")), 3).alias("fine"))
