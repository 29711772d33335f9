"""Documents, manifests and incremental work: hashes, diffs, merges, to-do lists and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.registry import query
from framewright.sources.views import poly, seq, table, with_views


def _manifests(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("value"), F.col("p_partkey").alias("k"), "p_brand")
    a = p.where("k % 5 <> 0").select("key", "value")
    b = p.where("k % 7 <> 0").select("key", F.when(F.col("k") % 3 == 0, F.col("p_brand")).otherwise(F.col("value")).alias("value"))
    return a, b


_MANIFESTS = """WITH a AS (SELECT 'part.' || p_partkey AS key, p_name AS value FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT 'part.' || p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS value FROM part WHERE p_partkey % 7 <> 0)
"""


@query("manifest_diff", _MANIFESTS + "SELECT coalesce(a.key, b.key) AS key, a.value AS old, b.value AS new FROM a FULL JOIN b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value")
def manifest_diff(spark, sf_dir):
    a, b = _manifests(spark, sf_dir)
    return a.withColumnRenamed("value", "old").join(b.withColumnRenamed("value", "new"), "key", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))


@query("mirror_sync", _MANIFESTS + """, r AS (SELECT key, CASE WHEN length(key) % 2 = 0 THEN sha256(value) ELSE 'x' END AS sha FROM a)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'missing' WHEN a.key IS NULL THEN CASE WHEN r.sha IS NULL THEN 'kept' ELSE 'remove' END WHEN sha256(a.value) = sha256(b.value) THEN 'ok' WHEN r.sha = sha256(b.value) THEN 'stale' ELSE 'edited' END AS state FROM a FULL JOIN b ON a.key = b.key LEFT JOIN r ON r.key = coalesce(a.key, b.key)""")
def mirror_sync(spark, sf_dir):
    """What a mirror has to do for each file, from the hashes of source, target and record."""
    a, b = _manifests(spark, sf_dir)
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    r = a.select("key", F.when(F.length("key") % 2 == 0, sha("value")).otherwise("x").alias("r"))
    both = a.select("key", sha("value").alias("a")).join(b.select("key", sha("value").alias("b")), "key", "full_outer").join(r, "key", "left")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), F.when(F.col("r").isNull(), "kept").otherwise("remove")).when(F.col("a") == F.col("b"), "ok").when(F.col("r") == F.col("b"), "stale").otherwise("edited")
    return both.select("key", state.alias("state"))


@query("merge_documents", _MANIFESTS + "SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prio DESC) AS r FROM (SELECT *, 0 AS prio FROM a UNION ALL SELECT *, 1 FROM b)) WHERE r = 1")
def merge_documents(spark, sf_dir):
    """Upsert: the later document's value wins."""
    a, b = _manifests(spark, sf_dir)
    every = a.withColumn("prio", F.lit(0)).unionByName(b.withColumn("prio", F.lit(1)))
    return every.groupBy("key").agg(F.max_by("value", "prio").alias("value"))


@query("expected_labels", _MANIFESTS + "SELECT key FROM a EXCEPT ALL SELECT key FROM b")
def expected_labels(spark, sf_dir):
    a, b = _manifests(spark, sf_dir)
    return a.select("key").exceptAll(b.select("key"))


@query("cache_lookup", _MANIFESTS + "SELECT b.key, a.value IS NOT DISTINCT FROM b.value AS hit FROM b LEFT JOIN a USING (key)")
def cache_lookup(spark, sf_dir):
    """Recompute where the stored inputs aren't those of now."""
    a, b = _manifests(spark, sf_dir)
    return b.join(a.withColumnRenamed("value", "stored"), "key", "left").select("key", F.col("stored").eqNullSafe(F.col("value")).alias("hit"))


@query("section_hash", "SELECT n_regionkey AS section, sha256(string_agg(n_nationkey || '=' || n_name, chr(10) ORDER BY n_nationkey)) AS sha FROM nation GROUP BY 1")
def section_hash(spark, sf_dir):
    """One hash of a section's settings in the order of their keys."""
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat(F.col("n_nationkey").cast("string"), F.lit("="), F.col("n_name")).alias("t"))))
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("section")).agg(rows.alias("r"))
    return n.select("section", F.sha2(F.array_join(F.transform("r", lambda s: s["t"]), "\n").cast("binary"), 256).alias("sha"))


@query("frames_fingerprint", "SELECT conv_id, sha256(string_agg(sha256(text), chr(10) ORDER BY turn)) AS sha FROM conversations GROUP BY 1")
def frames_fingerprint(spark, sf_dir):
    """A clip's identity: the hash of its frames' hashes in order."""
    rows = F.array_sort(F.collect_list(F.struct("turn", F.sha2(F.col("text").cast("binary"), 256).alias("h"))))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(rows.alias("r"))
    return c.select("conv_id", F.sha2(F.array_join(F.transform("r", lambda s: s["h"]), "\n").cast("binary"), 256).alias("sha"))


@query("stroke_document", with_views("SELECT stroke, '{\"frame_index\":' || any_value(frame) || ',\"points\":[' || string_agg('[' || (x * 1000)::BIGINT || ',' || (y * 1000)::BIGINT || ']', ',' ORDER BY j) || ']}' AS doc FROM poly GROUP BY 1", "poly"))
def stroke_document(spark, sf_dir):
    """Compact canonical JSON of a stroke, coordinates in thousandths."""
    whole = lambda c: F.rint(F.col(c) * 1000).cast("long")
    p = poly(spark, sf_dir).groupBy("stroke", "frame").agg(F.array_sort(F.collect_list(F.struct("j", F.array(whole("x"), whole("y")).alias("q")))).alias("r"))
    return p.select("stroke", F.to_json(F.struct(F.col("frame").alias("frame_index"), F.transform("r", lambda s: s["q"]).alias("points"))).alias("doc"))


@query("svg_document", with_views("SELECT stroke, '<path d=\"M' || string_agg(printf('%.3f', x + 0.0::DOUBLE) || ' ' || printf('%.3f', y + 0.0::DOUBLE), ' L' ORDER BY j) || '\"/>' AS svg FROM poly GROUP BY 1", "poly"))
def svg_document(spark, sf_dir):
    """A stroke as an SVG path with three decimals; zero has no sign."""
    p = poly(spark, sf_dir).groupBy("stroke").agg(F.array_sort(F.collect_list(F.struct("j", F.format_string("%.3f %.3f", "x", "y").alias("t")))).alias("r"))
    return p.select("stroke", F.concat(F.lit('<path d="M'), F.array_join(F.transform("r", lambda s: s["t"]), " L"), F.lit('"/>')).alias("svg"))


@query("flatten_keys", "SELECT event_id, 'props.k' AS key, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 'event.type', event_type FROM events")
def flatten_keys(spark, sf_dir):
    """Nested documents as dotted keys."""
    e = table(spark, sf_dir, "events")
    m = F.map_concat(F.transform_keys(F.from_json("props", "map<string,string>"), lambda k, _: F.concat(F.lit("props."), k)), F.create_map(F.lit("event.type"), F.col("event_type")))
    return e.select("event_id", F.explode(m).alias("key", "value"))


@query("todo_list", with_views("SELECT s.clip, s.i FROM seq s WHERE NOT EXISTS (SELECT 1 FROM seq d WHERE d.clip = s.clip AND d.i = s.i AND d.k IN ('click', 'view') AND d.v < 100)", "seq"))
def todo_list(spark, sf_dir):
    """Frames without a valid output yet."""
    s = seq(spark, sf_dir)
    return s.select("clip", "i").join(s.where("k in ('click', 'view') and v < 100").select("clip", "i"), ["clip", "i"], "left_anti")


@query("prompt_status", with_views("""
d AS (SELECT clip, i, sha256(k || clip) AS sha FROM seq WHERE i % 3 <> 0)
SELECT s.clip, s.i, CASE WHEN d.sha IS NULL THEN 'missing' WHEN d.sha = sha256('click' || s.clip) THEN 'ok' ELSE 'stale' END AS status FROM seq s LEFT JOIN d USING (clip, i)""", "seq"))
def prompt_status(spark, sf_dir):
    s = seq(spark, sf_dir)
    clip = F.col("clip").cast("string")
    d = s.where("i % 3 <> 0").select("clip", "i", F.sha2(F.concat("k", clip).cast("binary"), 256).alias("sha"))
    now = F.sha2(F.concat(F.lit("click"), clip).cast("binary"), 256)
    return s.join(d, ["clip", "i"], "left").select("clip", "i", F.when(F.col("sha").isNull(), "missing").when(F.col("sha") == now, "ok").otherwise("stale").alias("status"))


@query("mask_policy", with_views("SELECT clip, i, CASE k WHEN 'click' THEN 'apply' WHEN 'view' THEN 'apply' WHEN 'error' THEN 'clear' ELSE 'keep' END AS how FROM seq", "seq"))
def mask_policy(spark, sf_dir):
    k = F.col("k")
    return seq(spark, sf_dir).select("clip", "i", F.when(k.isin("click", "view"), "apply").when(k == "error", "clear").otherwise("keep").alias("how"))


@query("run_summary", "SELECT o_orderstatus AS status, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1")
def run_summary(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("batch_plan", """
WITH o AS (SELECT o_custkey AS clip, o_orderkey, ceil(o_totalprice / 1000)::BIGINT AS frames, o_orderstatus AS st, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS same FROM orders)
SELECT o_orderkey, frames, round(CASE WHEN st = 'F' THEN 0 ELSE frames * 8.735::DOUBLE END, 3) AS gpu_s, concat_ws(',', CASE WHEN same > 1 THEN 'duplicate' END, CASE WHEN frames > 400 THEN 'long' END) AS problems FROM o""")
def batch_plan(spark, sf_dir):
    """A dry run: what each clip would cost and what stands against it."""
    o = table(spark, sf_dir, "orders").withColumn("same", F.count("*").over(Window.partitionBy("o_custkey", "o_orderpriority"))).withColumn("frames", F.ceil(F.col("o_totalprice") / 1000))
    return o.select("o_orderkey", "frames", F.round(F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(F.col("frames") * 8.735), 3).alias("gpu_s"), F.concat_ws(",", F.when(F.col("same") > 1, "duplicate"), F.when(F.col("frames") > 400, "long")).alias("problems"))


@query("event_log", "SELECT conv_id, turn, try_cast(json_extract_string('{\"turn\":' || turn || CASE WHEN turn % 5 = 4 THEN '' ELSE '}' END, '$.turn') AS BIGINT) AS parsed FROM conversations WHERE turn % 5 <> 4")
def event_log(spark, sf_dir):
    """A line-by-line log of JSON: lines that are cut off are skipped."""
    c = table(spark, sf_dir, "conversations").withColumn("line", F.concat(F.lit('{"turn":'), F.col("turn").cast("string"), F.when(F.col("turn") % 5 == 4, "").otherwise("}")))
    c = c.withColumn("rec", F.from_json("line", "turn long, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    return c.where("rec._corrupt is null").select("conv_id", "turn", F.col("rec.turn").alias("parsed"))


@query("list_file", "SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/]+)(/[^?#]*)?', 2) AS host, url LIKE '%.html' AS html FROM pages ORDER BY url")
def list_file(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://([^/]+)(/[^?#]*)?", 2).alias("host"), F.col("url").endswith(".html").alias("html"))
