"""Quality rows and rules of a clip of group maps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.plans.groups import RADIUS, RHO, smooth
from framewright.registry import query
from framewright.sources.views import HEIGHT, WIDTH, gmap, px, seq, table, with_views

_ROWS = """
prev AS (SELECT a.frame, a.y, a.x, a.g, b.g AS p FROM gmap a LEFT JOIN gmap b ON b.frame = a.frame - 1 AND b.y = a.y AND b.x = a.x),
m AS (SELECT frame, count(*) FILTER (WHERE g <> 0) AS area, avg((g <> 0)::INT) AS share,
  CASE WHEN count(p) = 0 THEN NULL WHEN count(*) FILTER (WHERE g <> 0 OR p <> 0) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE g <> 0 AND p <> 0) / count(*) FILTER (WHERE g <> 0 OR p <> 0) END AS iou,
  avg((g = p)::INT) FILTER (WHERE g <> 0 AND p <> 0) AS agree FROM prev GROUP BY 1),
med AS (SELECT a.frame, median(b.area) AS med FROM m a JOIN m b ON b.frame >= greatest(0, least(a.frame - 4, 24 - 9)) AND b.frame < greatest(0, least(a.frame - 4, 24 - 9)) + 9 GROUP BY 1),
qc AS (SELECT m.*, med, CASE WHEN med > 0 THEN area / med END AS versus FROM m JOIN med USING (frame)),
reasons AS (SELECT *, list_filter([CASE WHEN share < 0.55 OR share > 0.99 THEN 'area_ratio' END, CASE WHEN iou < 0.65 THEN 'iou_prev' END, CASE WHEN versus < 0.97 THEN 'area_vs_median' END], lambda s: s IS NOT NULL) AS r FROM qc)"""


def quality_rows(spark, sf_dir):
    """One row a frame; a measure that can't be taken is null, and a null fails no rule."""
    m = gmap(spark, sf_dir)
    prev = m.withColumn("p", F.lag("g").over(Window.partitionBy("y", "x").orderBy("frame")))
    fg, pf = F.col("g") != 0, F.col("p") != 0
    union, both = F.count_if(fg | pf), F.count_if(fg & pf)
    rows = prev.groupBy("frame").agg(
        F.count_if(fg).alias("area"),
        F.avg(fg.cast("int")).alias("share"),
        F.when(F.count("p") > 0, F.when(union == 0, 1.0).otherwise(both / F.when(union > 0, union))).alias("iou"),
        F.avg(F.when(fg & pf, (F.col("g") == F.col("p")).cast("int"))).alias("agree"),
    )
    from framewright.plans.sequences import shifted_median

    rows = shifted_median(rows.withColumn("clip", F.lit(0)).withColumn("i", F.col("frame")), "area", 9)
    rows = rows.withColumn("versus", F.when(F.col("med") > 0, F.col("area") / F.col("med")))
    rules = F.array(F.when((F.col("share") < 0.55) | (F.col("share") > 0.99), "area_ratio"), F.when(F.col("iou") < 0.65, "iou_prev"), F.when(F.col("versus") < 0.97, "area_vs_median"))
    return rows.withColumn("r", F.filter(rules, lambda s: s.isNotNull()))


@query("qc_rows", with_views(_ROWS.strip() + "\nSELECT frame, area, round(share, 6) AS share, round(iou, 6) AS iou, round(agree, 6) AS agree, med, round(versus, 6) AS versus, array_to_string(r, ',') AS reasons FROM reasons", "gmap"))
def qc_rows(spark, sf_dir):
    r = quality_rows(spark, sf_dir)
    return r.select("frame", "area", F.round("share", 6).alias("share"), F.round("iou", 6).alias("iou"), F.round("agree", 6).alias("agree"), "med", F.round("versus", 6).alias("versus"), F.array_join("r", ",").alias("reasons"))


@query("qc_summary", with_views(_ROWS.strip() + """
SELECT count(*) AS n_frames, count(*) FILTER (WHERE len(r) > 0) AS n_fail, count(*) FILTER (WHERE list_contains(r, 'iou_prev')) AS n_iou, count(*) FILTER (WHERE list_contains(r, 'area_vs_median')) AS n_versus,
  round(avg(iou), 6) AS iou_mean, round(median(iou), 6) AS iou_median, round(min(iou), 6) AS iou_min, round(max(iou), 6) AS iou_max, array_to_string(list(frame ORDER BY frame) FILTER (WHERE len(r) > 0), ',') AS frames FROM reasons""", "gmap"))
def qc_summary(spark, sf_dir):
    return quality_rows(spark, sf_dir).agg(
        F.count("*").alias("n_frames"),
        F.count_if(F.size("r") > 0).alias("n_fail"),
        F.count_if(F.array_contains("r", "iou_prev")).alias("n_iou"),
        F.count_if(F.array_contains("r", "area_vs_median")).alias("n_versus"),
        *(F.round(f("iou"), 6).alias(f"iou_{n}") for n, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))),
        F.array_join(F.array_sort(F.collect_list(F.when(F.size("r") > 0, F.col("frame")))), ",").alias("frames"),
    )


@query("qc_warning", with_views(_ROWS.strip() + "\nSELECT count(*) AS n, array_to_string(list_slice(list(frame ORDER BY frame), 1, 10), ' ') AS first FROM reasons WHERE len(r) > 0", "gmap"))
def qc_warning(spark, sf_dir):
    """How many frames fail, and the first ten of them."""
    bad = quality_rows(spark, sf_dir).where(F.size("r") > 0)
    first = bad.select("frame").orderBy("frame").limit(10).agg(F.array_join(F.array_sort(F.collect_list("frame")), " ").alias("first"))
    return bad.agg(F.count("*").alias("n")).crossJoin(F.broadcast(first))  # one row each


@query("argmax_mismatch", with_views("SELECT frame, round(avg((g <> (y + x + frame) % 4)::INT) * 100, 6) AS pct FROM gmap GROUP BY 1", "gmap"))
def argmax_mismatch(spark, sf_dir):
    return gmap(spark, sf_dir).groupBy("frame").agg(F.round(F.avg((F.col("g") != (F.col("y") + F.col("x") + F.col("frame")) % 4).cast("int")) * 100, 6).alias("pct"))


@query("outputs_valid", with_views("SELECT frame, count(*) AS n, count(*) FILTER (WHERE g < 0 OR g > 3) AS bad, count(*) = 160 AND count(*) FILTER (WHERE g < 0 OR g > 3) = 0 AS valid FROM gmap GROUP BY 1", "gmap"))
def outputs_valid(spark, sf_dir):
    bad = F.count_if((F.col("g") < 0) | (F.col("g") > 3))
    return gmap(spark, sf_dir).groupBy("frame").agg(F.count("*").alias("n"), bad.alias("bad"), ((F.count("*") == HEIGHT * WIDTH) & (bad == 0)).alias("valid"))


@query("missing_frames", with_views("SELECT c.clip, f.i::INT AS frame FROM (SELECT clip, count(*) AS n FROM seq GROUP BY 1) c CROSS JOIN range(100) f(i) WHERE f.i < c.n AND NOT EXISTS (SELECT 1 FROM seq s WHERE s.clip = c.clip AND s.i = f.i AND s.k <> 'error')", "seq"))
def missing_frames(spark, sf_dir):
    """Frames that a clip should have and that hold no valid output."""
    s = seq(spark, sf_dir)
    wanted = s.groupBy("clip").agg(F.count("*").alias("n")).select("clip", F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(100)).cast("int") - 1)).alias("frame"))
    return wanted.join(s.where("k <> 'error'").select("clip", F.col("i").alias("frame")), ["clip", "frame"], "left_anti")


@query("qc_fail_flags", with_views("SELECT f.clip, f.i, bool_or(q.k = 'error') AS fails FROM seq f LEFT JOIN seq q ON q.clip = f.clip AND q.i = f.i AND q.k <> 'view' GROUP BY ALL", "seq"))
def qc_fail_flags(spark, sf_dir):
    s = seq(spark, sf_dir)
    q = s.where("k <> 'view'").select("clip", "i", (F.col("k") == "error").alias("fails"))
    return s.select("clip", "i").join(q, ["clip", "i"], "left")


@query("disparity_stats", with_views("SELECT frame, min(d) AS lo, median(d) AS mid, max(d) AS hi FROM depth GROUP BY 1", "depth"))
def disparity_stats(spark, sf_dir):
    from framewright.sources.views import depth

    return depth(spark, sf_dir).groupBy("frame").agg(F.min("d").alias("lo"), F.median("d").alias("mid"), F.max("d").alias("hi"))


_DEPTH = """
l AS (SELECT d.frame, d.y, d.x, ln(greatest(d, 1.5)) AS v, g FROM depth d JOIN gmap USING (frame, y, x)),
st AS (SELECT frame, coalesce(quantile_cont(v, 0.5) FILTER (WHERE g <> 1), quantile_cont(v, 0.5)) AS m, coalesce(quantile_cont(v, 0.75) FILTER (WHERE g <> 1) - quantile_cont(v, 0.25) FILTER (WHERE g <> 1), quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS iqr FROM l GROUP BY 1)"""


def _log_depth(spark, sf_dir):
    """Log depth with each frame's median and quartile range, over the foreground or, without any, the whole frame."""
    from framewright.sources.views import depth

    v = depth(spark, sf_dir).withColumn("v", F.log(F.greatest("d", F.lit(1.5)))).join(gmap(spark, sf_dir), ["frame", "y", "x"])
    fg = F.when(F.col("g") != 1, F.col("v"))
    st = v.groupBy("frame").agg(*(F.coalesce(F.percentile(fg, p), F.percentile("v", p)).alias(n) for n, p in (("a", 0.25), ("m", 0.5), ("b", 0.75))))
    return v.join(F.broadcast(st), "frame")  # a row for each frame of a clip


@query("depth_log_median", with_views(_DEPTH.strip() + "\nSELECT frame, y, x, round(v - m, 6) AS z FROM l JOIN st USING (frame)", "depth", "gmap"))
def depth_log_median(spark, sf_dir):
    return _log_depth(spark, sf_dir).select("frame", "y", "x", F.round(F.col("v") - F.col("m"), 6).alias("z"))


@query("depth_log_median_iqr", with_views(_DEPTH.strip() + "\nSELECT frame, y, x, round((v - m) / greatest(iqr, 0.05), 6) AS z FROM l JOIN st USING (frame)", "depth", "gmap"))
def depth_log_median_iqr(spark, sf_dir):
    return _log_depth(spark, sf_dir).select("frame", "y", "x", F.round((F.col("v") - F.col("m")) / F.greatest(F.col("b") - F.col("a"), F.lit(0.05)), 6).alias("z"))


_SMOOTH_DEPTH = f"""
z AS (SELECT frame, y, x, v - m AS z FROM l JOIN st USING (frame)),
zs AS (SELECT a.frame, a.y, a.x, sum({RHO!r}::DOUBLE ** abs(b.frame - a.frame) * b.z) AS n, sum({RHO!r}::DOUBLE ** abs(b.frame - a.frame)) AS m FROM z a JOIN z b ON b.y = a.y AND b.x = a.x AND b.frame BETWEEN a.frame - {RADIUS} AND a.frame + {RADIUS} GROUP BY 1, 2, 3)"""


@query("smoothed_depth", with_views(_DEPTH.strip() + "," + _SMOOTH_DEPTH + "\nSELECT frame, y, x, round(n / m, 5) AS z FROM zs", "depth", "gmap"))
def smoothed_depth(spark, sf_dir):
    """Normalised depth under the same kernel over time as the groups."""
    z = _log_depth(spark, sf_dir).select("frame", "y", "x", (F.col("v") - F.col("m")).alias("z"))
    n, m = smooth("z", None, ["y", "x"], "frame", RHO, RADIUS)
    return z.select("frame", "y", "x", F.round(n / m, 5).alias("z"))


@query("half_depth", with_views("SELECT frame, count(*) FILTER (WHERE d * 40 > 65504) AS over, round(min(CASE WHEN d * 40 > 65504 THEN 0 ELSE d * 40 END), 4) AS lo FROM depth GROUP BY 1", "depth"))
def half_depth(spark, sf_dir):
    """What a half float can't hold becomes 0 and is counted."""
    from framewright.sources.views import depth

    big = F.col("d") * 40 > 65504
    return depth(spark, sf_dir).groupBy("frame").agg(F.count_if(big).alias("over"), F.round(F.min(F.when(big, 0.0).otherwise(F.col("d") * 40)), 4).alias("lo"))


_SOFT = """
m AS (SELECT frame, y, x, max(s / 50.0::DOUBLE) AS top FROM px GROUP BY ALL), e AS (SELECT px.*, exp(s / 50.0::DOUBLE - top) AS e FROM px JOIN m USING (frame, y, x)),
p AS (SELECT frame, y, x, g, e / sum(e) OVER (PARTITION BY frame, y, x) AS p FROM e)"""


@query("softmax_probabilities", with_views(_SOFT.strip() + "\nSELECT frame, y, x, g, round(p, 6) AS p FROM p", "px"))
def softmax_probabilities(spark, sf_dir):
    return softmax(px(spark, sf_dir), "s", 50.0).select("frame", "y", "x", "g", F.round("p", 6).alias("p"))


def softmax(scores, score: str, scale: float):
    """Stable softmax over the groups of a cell."""
    cell = Window.partitionBy("frame", "y", "x")
    z = F.col(score) / F.lit(scale)
    e = scores.withColumn("e", F.exp(z - F.max(z).over(cell)))
    return e.withColumn("p", F.col("e") / F.sum("e").over(cell)).drop("e")


@query("softmax_classmap", with_views(_SOFT.strip() + ",\nb AS (SELECT *, row_number() OVER (PARTITION BY frame, y, x ORDER BY round(p, 9) DESC, g) AS r FROM p)\nSELECT frame, y, x, g, floor(255 * round(p, 6) + 0.5)::INT AS p255 FROM b WHERE r = 1", "px"))
def softmax_classmap(spark, sf_dir):
    b = softmax(px(spark, sf_dir), "s", 50.0).groupBy("frame", "y", "x").agg(F.max(F.struct(F.round("p", 9).alias("r"), (-F.col("g")).alias("g"), "p")).alias("b"))
    return b.select("frame", "y", "x", (-F.col("b.g")).alias("g"), F.floor(255 * F.round("b.p", 6) + 0.5).cast("int").alias("p255"))


@query("target_threshold", with_views("SELECT frame, y, x, g, coalesce((s / 100.0)::FLOAT > 1.5::FLOAT, false) AS hit FROM px", "px"))
def target_threshold(spark, sf_dir):
    """Strictly above, at single precision; NaN is not above anything."""
    z = (F.col("s") / 100.0).cast("float")
    return px(spark, sf_dir).select("frame", "y", "x", "g", (~F.isnan(z) & (z > F.lit(1.5).cast("float"))).alias("hit"))


@query("pixel_stats", with_views("SELECT y, x, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS sd, max(s) AS top FROM px GROUP BY 1, 2", "px"))
def pixel_stats(spark, sf_dir):
    return px(spark, sf_dir).groupBy("y", "x").agg(F.round(F.avg("s"), 6).alias("mean"), F.round(F.stddev_pop("s"), 6).alias("sd"), F.max("s").alias("top"))


_STAT = "st AS (SELECT y, x, avg(s) AS m, stddev_pop(s) AS sd FROM px GROUP BY 1, 2), {axis} AS (SELECT {k} AS pos, avg((sd <= 200)::INT) AS still, stddev_pop(m) AS flat FROM st GROUP BY 1)"


def _lines(spark, sf_dir, axis):
    st = px(spark, sf_dir).groupBy("y", "x").agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("sd"))
    return st.groupBy(F.col(axis).alias("pos")).agg(F.avg((F.col("sd") <= 200).cast("int")).alias("still"), F.stddev_pop("m").alias("flat"))


@query("static_lines", with_views(_STAT.format(axis="rows", k="y") + ", cols AS (SELECT x AS pos, avg((sd <= 200)::INT) AS still, stddev_pop(m) AS flat FROM st GROUP BY 1)" + "\nSELECT 'row' AS axis, pos, round(still, 6) AS still, round(flat, 6) AS flat, still >= 0.5 AND flat <= 100 AS ok FROM rows UNION ALL SELECT 'column', pos, round(still, 6), round(flat, 6), still >= 0.5 AND flat <= 100 FROM cols", "px"))
def static_lines(spark, sf_dir):
    """Rows and columns that hardly change: over time and along themselves."""
    ok = (F.col("still") >= 0.5) & (F.col("flat") <= 100)
    parts = [_lines(spark, sf_dir, a).select(F.lit(n).alias("axis"), "pos", F.round("still", 6).alias("still"), F.round("flat", 6).alias("flat"), ok.alias("ok")) for n, a in (("row", "y"), ("column", "x"))]
    return parts[0].unionAll(parts[1])


@query("crop_hints", with_views(_STAT.format(axis="cols", k="x") + "\nSELECT 'left' AS side, coalesce(min(pos) FILTER (WHERE still < 0.5), 16)::BIGINT AS n FROM cols UNION ALL SELECT 'right', 15 - coalesce(max(pos) FILTER (WHERE still < 0.5), -1) FROM cols", "px"))
def crop_hints(spark, sf_dir):
    """How many still columns there are from either side inwards."""
    moving = F.when(F.col("still") < 0.5, F.col("pos"))
    c = _lines(spark, sf_dir, "x").agg(F.min(moving).alias("lo"), F.max(moving).alias("hi"))
    return c.select(F.inline(F.array(F.struct(F.lit("left").alias("side"), F.coalesce("lo", F.lit(WIDTH)).cast("long").alias("n")), F.struct(F.lit("right").alias("side"), (WIDTH - 1 - F.coalesce("hi", F.lit(-1))).cast("long").alias("n")))))


@query("prompt_rules", with_views("""
p AS (SELECT clip, i, 1 + (clip % 3) AS target, (k <> 'error')::INT AS label, v FROM seq)
SELECT clip, target, count(*) AS n, count(*) FILTER (WHERE label = 0) AS negative, count(*) FILTER (WHERE label = 1) > 0 AS has_positive, count(*) FILTER (WHERE label = 0) > 10 AS over_negative, count(*) FILTER (WHERE v < 0) = 0 AS in_frame FROM p GROUP BY 1, 2""", "seq"))
def prompt_rules(spark, sf_dir):
    p = seq(spark, sf_dir).select("clip", (1 + F.col("clip") % 3).alias("target"), (F.col("k") != "error").alias("positive"), "v")
    return p.groupBy("clip", "target").agg(F.count("*").alias("n"), F.count_if(~F.col("positive")).alias("negative"), (F.count_if("positive") > 0).alias("has_positive"), (F.count_if(~F.col("positive")) > 10).alias("over_negative"), (F.count_if(F.col("v") < 0) == 0).alias("in_frame"))


@query("revision_gate", "SELECT doc_id, regexp_matches(sha1(text), '^[0-9a-f]{40}$') AS pinned, regexp_extract(source, '([a-z]+)([0-9]+)', 1) AS family, regexp_extract(source, '([a-z]+)([0-9]+)', 2) AS rev FROM documents")
def revision_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha1("text").rlike("^[0-9a-f]{40}$").alias("pinned"), F.regexp_extract("source", "([a-z]+)([0-9]+)", 1).alias("family"), F.regexp_extract("source", "([a-z]+)([0-9]+)", 2).alias("rev"))
