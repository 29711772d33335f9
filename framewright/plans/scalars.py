"""Scalar geometry, parsing and formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.registry import query
from framewright.sources.views import table, with_views


def _meta(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", (F.col("o_custkey") % 1000 + 2).alias("w"), (F.col("o_orderkey") % 1000 + 2).alias("h"), (F.col("o_totalprice") / 1000).alias("sec"))


_META = "WITH meta AS (SELECT o_orderkey, o_custkey % 1000 + 2 AS w, o_orderkey % 1000 + 2 AS h, o_totalprice / 1000 AS sec FROM orders)\n"


@query("output_size", _META + "SELECT o_orderkey, least(w, 480) // 2 * 2 AS ow, greatest(2, 2 * floor(h * least(w, 480) / w / 2.0::DOUBLE + 0.5)::BIGINT) AS oh FROM meta")
def output_size(spark, sf_dir):
    """Scaled to a width without enlarging; both sides even, the height rounded half up."""
    w = F.least(F.col("w"), F.lit(480))
    return _meta(spark, sf_dir).select("o_orderkey", (F.floor(w / 2) * 2).alias("ow"), F.greatest(F.lit(2), 2 * F.floor(F.col("h") * w / F.col("w") / 2.0 + 0.5)).alias("oh"))


@query("aspect_half_up", _META + "SELECT o_orderkey, (2 * h * 1080 + w) // (2 * w) AS oh, ((2 * h * 1080 + w) // (2 * w)) + ((2 * h * 1080 + w) // (2 * w)) % 2 AS even FROM meta")
def aspect_half_up(spark, sf_dir):
    """Integer arithmetic only."""
    oh = F.expr("(2 * h * 1080 + w) div (2 * w)")
    return _meta(spark, sf_dir).withColumn("oh", oh).select("o_orderkey", "oh", (F.col("oh") + F.col("oh") % 2).alias("even"))


@query("round_box", _META + "SELECT o_orderkey, floor(sec / 2)::BIGINT * 2 AS x0, least(ceil((sec + w / 3.0::DOUBLE) / 2)::BIGINT * 2, w * 4) AS x1 FROM meta")
def round_box(spark, sf_dir):
    """A box grown outwards to even coordinates."""
    return _meta(spark, sf_dir).select("o_orderkey", (F.floor(F.col("sec") / 2) * 2).alias("x0"), F.least(F.ceil((F.col("sec") + F.col("w") / 3.0) / 2) * 2, F.col("w") * 4).alias("x1"))


@query("map_box_to_source", _META + "SELECT o_orderkey, floor(10 * 1920.0::DOUBLE / w)::BIGINT AS x0, floor(5 * 1080.0::DOUBLE / h)::BIGINT AS y0, least(1920, ceil((w - 1) * 1920.0::DOUBLE / w))::BIGINT AS x1, least(1080, ceil((h - 1) * 1080.0::DOUBLE / h))::BIGINT AS y1 FROM meta")
def map_box_to_source(spark, sf_dir):
    return _meta(spark, sf_dir).select(
        "o_orderkey", F.floor(F.lit(10 * 1920.0) / F.col("w")).alias("x0"), F.floor(F.lit(5 * 1080.0) / F.col("h")).alias("y0"), F.least(F.lit(1920), F.ceil((F.col("w") - 1) * F.lit(1920.0) / F.col("w"))).cast("long").alias("x1"), F.least(F.lit(1080), F.ceil((F.col("h") - 1) * F.lit(1080.0) / F.col("h"))).cast("long").alias("y1")
    )


@query("view_roundtrip", _META + "SELECT o_orderkey, floor((floor((w // 2) * 0.75::DOUBLE + 0.5) + 0.5) / 0.75::DOUBLE)::BIGINT AS back, floor((floor((w // 2) * 0.75::DOUBLE + 0.5) + 0.5) / 0.75::DOUBLE)::BIGINT = w // 2 AS same FROM meta")
def view_roundtrip(spark, sf_dir):
    """From frame to display and back."""
    x = F.expr("w div 2")
    back = F.floor((F.floor(x * 0.75 + 0.5) + 0.5) / 0.75)
    return _meta(spark, sf_dir).select("o_orderkey", back.alias("back"), (back == x).alias("same"))


@query("fit_view", _META + "SELECT o_orderkey, round(least(1280.0::DOUBLE / w, 720.0::DOUBLE / h, 4), 9) AS scale FROM meta")
def fit_view(spark, sf_dir):
    return _meta(spark, sf_dir).select("o_orderkey", F.round(F.least(F.lit(1280.0) / F.col("w"), F.lit(720.0) / F.col("h"), F.lit(4.0)), 9).alias("scale"))


@query("fade_curve", _META + "SELECT o_orderkey, round(t * t * t * (t * (t * 6 - 15) + 10), 9) AS f FROM (SELECT o_orderkey, sec - floor(sec) AS t FROM meta)")
def fade_curve(spark, sf_dir):
    t = F.col("t")
    return _meta(spark, sf_dir).withColumn("t", F.col("sec") - F.floor("sec")).select("o_orderkey", F.round(t * t * t * (t * (t * 6 - 15) + 10), 9).alias("f"))


@query("jitter_index", with_views("SELECT clip, i, i // 3 AS held, 0 AS fixed FROM seq", "seq"))
def jitter_index(spark, sf_dir):
    from framewright.sources.views import seq

    return seq(spark, sf_dir).select("clip", "i", F.expr("cast(i div 3 as int)").alias("held"), F.lit(0).alias("fixed"))


@query("multipass", with_views("SELECT stroke, j, p.i::INT AS pass, round(x + p.i * 0.25, 4) AS x, round(y - p.i * 0.25, 4) AS y FROM poly CROSS JOIN range(3) p(i)", "poly"))
def multipass(spark, sf_dir):
    """The same stroke drawn again, moved a little each time."""
    from framewright.sources.views import poly

    return poly(spark, sf_dir).select("stroke", "j", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pass")).select("stroke", "j", "pass", F.round(F.col("x") + F.col("pass") * 0.25, 4).alias("x"), F.round(F.col("y") - F.col("pass") * 0.25, 4).alias("y"))


@query("parse_rate", """
WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '30000/1001' WHEN 1 THEN (o_custkey % 60)::VARCHAR WHEN 2 THEN '25/0' ELSE 'n/a' END AS rate FROM orders)
SELECT o_orderkey, rate, round(CASE WHEN rate LIKE '%/%' THEN try_cast(split_part(rate, '/', 1) AS DOUBLE) / nullif(try_cast(split_part(rate, '/', 2) AS DOUBLE), 0) ELSE try_cast(rate AS DOUBLE) END, 9) AS fps FROM r""")
def parse_rate(spark, sf_dir):
    """Plain or rational rates; what can't be read is null."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    o = o.select("o_orderkey", F.when(k == 0, "30000/1001").when(k == 1, (F.col("o_custkey") % 60).cast("string")).when(k == 2, "25/0").otherwise("n/a").alias("rate"))
    part = lambda n: F.split_part("rate", F.lit("/"), F.lit(n)).try_cast("double")
    return o.select("o_orderkey", "rate", F.round(F.when(F.contains("rate", F.lit("/")), F.try_divide(part(1), part(2))).otherwise(F.col("rate").try_cast("double")), 9).alias("fps"))


@query("stream_rotation", "SELECT event_id, ((coalesce(try_cast(json_extract_string(props, '$.rotate') AS INT), try_cast(json_extract_string(props, '$.k') AS INT) * -90, 0) % 360) + 360) % 360 AS rotation FROM events")
def stream_rotation(spark, sf_dir):
    """A field of a JSON document, another in its place, else 0; as degrees from 0 to 359."""
    f = lambda p: F.get_json_object("props", p).try_cast("int")
    return table(spark, sf_dir, "events").select("event_id", F.pmod(F.coalesce(f("$.rotate"), f("$.k") * -90, F.lit(0)), F.lit(360)).alias("rotation"))


@query("sanitize_name", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9_-]+', '_', 'g') || '.limit' || (p_size % 5) AS name FROM part")
def sanitize_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.regexp_replace(F.lower("p_name"), "[^a-z0-9_-]+", "_"), F.lit(".limit"), (F.col("p_size") % 5).cast("string")).alias("name"))


@query("output_name", "SELECT p_partkey, replace(replace('{source}-{style}.mp4', '{source}', lower(p_brand)), '{style}', regexp_replace(p_type, ' ', '_', 'g')) AS name FROM part")
def output_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.replace(F.replace(F.lit("{source}-{style}.mp4"), F.lit("{source}"), F.lower("p_brand")), F.lit("{style}"), F.regexp_replace("p_type", " ", "_")).alias("name"))


@query("seconds_label", _META + "SELECT o_orderkey, rtrim(rtrim(printf('%.5f', sec), '0'), '.') AS label, CASE WHEN round(sec) % 2 = 0 THEN '\"a b\"' ELSE 'ab' END AS arg FROM meta")
def seconds_label(spark, sf_dir):
    m = _meta(spark, sf_dir)
    label = F.rtrim(F.rtrim(F.format_string("%.5f", "sec"), F.lit("0")), F.lit("."))
    arg = F.when(F.round("sec") % 2 == 0, F.lit("a b")).otherwise(F.lit("ab"))
    return m.select("o_orderkey", label.alias("label"), F.when(F.contains(arg, F.lit(" ")), F.concat(F.lit('"'), arg, F.lit('"'))).otherwise(arg).alias("arg"))


@query("decimal_comma", _META + "SELECT o_orderkey, replace(printf('%.5f', sec), '.', ',') AS v, trim('\"' || o_orderkey || '\"', '\"') AS unquoted FROM meta")
def decimal_comma(spark, sf_dir):
    quoted = F.concat(F.lit('"'), F.col("o_orderkey").cast("string"), F.lit('"'))
    return _meta(spark, sf_dir).select("o_orderkey", F.replace(F.format_string("%.5f", "sec"), F.lit("."), F.lit(",")).alias("v"), F.regexp_replace(quoted, '^"|"$', "").alias("unquoted"))


@query("hex_colour", "SELECT p_partkey, '#' || right('000000' || lower(printf('%x', (p_partkey * 7919) % 16777216)), 6) AS hex, (((p_partkey * 7919) % 16777216) // 65536)::INT AS r, ((((p_partkey * 7919) % 16777216) // 256) % 256)::INT AS g, (((p_partkey * 7919) % 16777216) % 256)::INT AS b, (p_partkey * 7919) % 16777216 AS packed FROM part")
def hex_colour(spark, sf_dir):
    """#rrggbb to its three parts and back to one number."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("#"), F.lpad(F.lower(F.hex((F.col("p_partkey") * 7919) % 16777216)), 6, "0")).alias("hex"))
    p = p.select("*", *(F.conv(F.substring("hex", 2 + 2 * i, 2), 16, 10).cast("int").alias(c) for i, c in enumerate("rgb")))
    packed = F.shiftleft(F.col("r").cast("long"), 16).bitwiseOR(F.shiftleft(F.col("g").cast("long"), 8)).bitwiseOR(F.col("b").cast("long"))
    return p.withColumn("packed", packed)


@query("suggest_keys", """
WITH d AS (SELECT a.n_name AS key, b.n_name AS known, levenshtein(a.n_name, b.n_name) AS d, row_number() OVER (PARTITION BY a.n_name ORDER BY levenshtein(a.n_name, b.n_name), b.n_name) AS r FROM nation a JOIN nation b ON a.n_name <> b.n_name WHERE levenshtein(a.n_name, b.n_name) <= 0.6 * greatest(length(a.n_name), length(b.n_name)))
SELECT key, known, d, r AS rank FROM d WHERE r <= 3""")
def suggest_keys(spark, sf_dir):
    """The three most similar known keys for an unknown one, among the 25 there are."""
    n = table(spark, sf_dir, "nation").select("n_name")
    known = n.agg(F.collect_list("n_name").alias("all"))  # 25 names
    near = F.filter(F.transform("all", lambda k: F.struct(F.levenshtein(F.col("n_name"), k).alias("d"), k.alias("known"))), lambda s: (s["known"] != F.col("n_name")) & (s["d"] <= 0.6 * F.greatest(F.length("n_name"), F.length(s["known"]))))
    return n.join(F.broadcast(known)).select(F.col("n_name").alias("key"), F.posexplode(F.slice(F.array_sort(near), 1, 3)).alias("rank", "s")).select("key", "s.known", "s.d", (F.col("rank") + 1).cast("long").alias("rank"))


@query("disk_estimate", _META + "SELECT o_orderkey % 10 AS bucket, round(sum(w * h * ceil(sec)) * 8.5 / 1e6, 3) AS mib, max(CASE WHEN w * h > 500000 THEN 2 WHEN w * h > 100000 THEN 1 ELSE 0 END) AS severity FROM meta GROUP BY 1")
def disk_estimate(spark, sf_dir):
    wh = F.col("w") * F.col("h")
    return _meta(spark, sf_dir).groupBy((F.col("o_orderkey") % 10).alias("bucket")).agg(F.round(F.sum(wh * F.ceil("sec")) * 8.5 / 1e6, 3).alias("mib"), F.max(F.when(wh > 500000, 2).when(wh > 100000, 1).otherwise(0)).alias("severity"))


@query("utc_labels", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS stamp FROM events")
def utc_labels(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("stamp"))


#: The width that lengths of a style refer to, and the steepness from which a displaced line may fold.
REFERENCE_WIDTH, FOLD = 1080, 0.19


@query("pen_geometry", f"""
WITH s AS (SELECT p_partkey, (256 + 32 * p_size)::DOUBLE AS w, (256 + 32 * p_size) / {REFERENCE_WIDTH}.0::DOUBLE AS unit FROM part)
SELECT p_partkey, round(unit, 6) AS unit, round(4 * unit, 6) AS width, round(2.8 * unit, 6) AS epsilon, round(5 * unit, 6) AS smooth, round(w / 480, 6) AS scale, 4 * unit < w / 480 AS too_thin FROM s""")
def pen_geometry(spark, sf_dir):
    """Lengths of a style at an output width; lines thinner than the scale don't reach the edge they end on."""
    w = (256 + 32 * F.col("p_size")).cast("double")
    s = table(spark, sf_dir, "part").select("p_partkey", w.alias("w"), (w / REFERENCE_WIDTH).alias("unit"))
    at = lambda v, name: F.round(v * F.col("unit"), 6).alias(name)
    return s.select("p_partkey", at(1, "unit"), at(4, "width"), at(2.8, "epsilon"), at(5, "smooth"), F.round(F.col("w") / 480, 6).alias("scale"), (4 * F.col("unit") < F.col("w") / 480).alias("too_thin"))


@query("fold_ratio", f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity / 10::DOUBLE * l_tax * (sqrt(1 - l_discount) + sqrt(l_discount)) AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, round(r, 6) AS r, r > {FOLD} AS warn FROM r""")
def fold_ratio(spark, sf_dir):
    """Amplitude times frequency of a displacement whose strokes are partly independent, and whether lines may fold."""
    share = F.col("l_discount").cast("double")
    r = F.col("l_quantity").cast("double") / 10 * F.col("l_tax").cast("double") * (F.sqrt(1 - share) + F.sqrt(share))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(r, 6).alias("r"), (r > FOLD).alias("warn"))
