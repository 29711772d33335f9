"""URL filtering by a sort-merge range join of reversed-host keys with prefix rules.

The labels of a host are reversed and each ended by a dot, so that a host and all its subdomains are
one interval of the sorted keys; a path prefix is an interval as well. Prefix intervals nest or are
disjoint. The sweep walks the sorted union of keys, interval starts and interval ends: a start pushes
its rule, an end pops one, and the running sum of both is the height of the stack. The rule at height
h of the stack is the last one pushed at that height, so the stack is one running value for each
height, and at a key those up to its own height are active. The walk is a range-partitioned sort;
height and stack at the beginning of a partition are carried over from the partitions before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm.common import durable, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest) + 1), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit(".")))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(host, path, verdict) from pairs such as ("block", "example.org/es/")."""
    parts = [F.struct(F.lit(r.partition("/")[0]).alias("host"), F.lit("/" + r.partition("/")[2]).alias("path"), F.lit(v).alias("verdict")) for v, r in rules]
    return spark.range(1).select(F.inline(F.array(*parts))) if parts else spark.range(0).selectExpr("'' as host", "'' as path", "'' as verdict")


def enclosing(points: DataFrame, starts: DataFrame) -> DataFrame:
    """(key, stack): for each distinct ``points.key`` the ``starts.key`` that are prefixes of it, shortest first; none: no row.

    The sweep has a running value for each height up to that of the highest stack, which follows how
    deeply rules nest and not how many there are.
    """
    starts = durable(starts.select("key").distinct())
    at = F.col("key").cast("binary")
    push, point, pop = F.lit(0), F.lit(1), F.lit(2)
    events = points.select("key").distinct().select("key", at.alias("at"), point.alias("kind")).unionAll(starts.select("key", at.alias("at"), push.alias("kind")))
    events = events.unionAll(starts.select("key", F.concat(at, F.lit(b"\xff")).alias("at"), pop.alias("kind")))  # no UTF-8 text has this byte, so it sorts behind all that begins with the key
    swept = durable(events.repartitionByRange("at", "kind").withColumn("part", F.spark_partition_id()))
    step = F.when(F.col("kind") == push, 1).when(F.col("kind") == pop, -1).otherwise(0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each partition
    opened = swept.groupBy("part").agg(F.sum(step).alias("net")).select("part", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("opened"))
    walk = Window.partitionBy("part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = durable(swept.join(F.broadcast(opened), "part").withColumn("height", F.col("opened") + F.sum(step).over(walk)))
    highest = swept.agg(F.max("height")).first()[0] or 0
    if not highest:
        return points.select("key", F.array("key").alias("stack")).limit(0)
    heights = range(1, highest + 1)
    pushed = lambda h: F.when((F.col("kind") == push) & (F.col("height") == h), F.col("key"))
    left = swept.groupBy("part").agg(*(F.max(pushed(h)).alias(f"h{h}") for h in heights))  # starts are pushed in the order of their keys
    carry = left.select("part", *(F.last(f"h{h}", ignorenulls=True).over(before).alias(f"h{h}") for h in heights))
    top = swept.join(F.broadcast(carry), "part").select("key", "kind", "height", *(F.coalesce(F.last(pushed(h), ignorenulls=True).over(walk), F.col(f"h{h}")).alias(f"s{h}") for h in heights))
    return top.where((F.col("kind") == point) & (F.col("height") > 0)).select("key", F.slice(F.array(*(f"s{h}" for h in heights)), 1, F.col("height").cast("int")).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each row of ``pages`` (page_id, url, any others).

    A rule (host, path, verdict) fits its host and all subdomains where the URL's path starts with
    the rule's. The longest fitting rule (host and path together) wins, on a tie the longer host;
    of equal rules one that blocks. Without any, rule is null and the verdict ``default``. Null or
    malformed URLs have an empty host and path, which no rule fits. Repeated rows are each judged;
    rules with a null part are no rules. Equal hosts and paths are swept once however common.
    """
    host, path = host_and_path(F.col("url"))
    rows = durable(pages.select("page_id", host.alias("host"), path.alias("path")))
    own = durable(
        rules.where("host is not null and path is not null and verdict is not null and host <> ''")
        .select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(host_key(F.col("host")).alias("rule_host"), F.concat("host", "path").alias("rule"), "path", "verdict")
    )
    seen = rows.where("host <> ''").select("host", "path").distinct().withColumn("key", host_key(F.col("host")))
    by_host = enclosing(seen.select("key"), own.select(F.col("rule_host").alias("key")))
    full = lambda h, p: F.concat(h, F.lit("/\u0001"), p)
    probes = durable(seen.join(by_host, "key").select("host", "path", F.explode("stack").alias("rule_host")).withColumn("key", full(F.col("rule_host"), F.col("path"))))
    by_path = enclosing(probes.select("key"), own.select(full(F.col("rule_host"), F.col("path")).alias("key"))).select("key", F.try_element_at("stack", F.lit(-1)).alias("found"))
    fits = probes.join(by_path, "key").join(own.select(full(F.col("rule_host"), F.col("path")).alias("found"), "rule", "verdict"), "found")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("m"), "verdict", "rule")).alias("best"))
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


ORACLE = """
WITH rules(verdict, host, path) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rests),
parts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut),
best AS (
  SELECT p.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY 1)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM parts p LEFT JOIN best b USING (page_id)
"""
