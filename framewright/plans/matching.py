"""Matching strokes and points: distances between sets of points, proximity joins, overrides and prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from framewright.operators import kernels
from framewright.plans.polyline import _AREA, signed, strokes
from framewright.registry import query
from framewright.sources.views import poly, seq, with_views

_COST = """
k AS (SELECT stroke, any_value(frame) AS frame, any_value(type) AS type FROM poly GROUP BY 1),
pr AS (SELECT a.stroke AS cur, b.stroke AS prev, a.frame FROM k a JOIN k b ON b.frame = a.frame - 1 AND b.type = a.type),
dd AS (SELECT pr.cur, pr.prev, p.j AS pj, q.j AS qj, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS d FROM pr JOIN poly p ON p.stroke = pr.cur JOIN poly q ON q.stroke = pr.prev),
fw AS (SELECT cur, prev, avg(d) AS d FROM (SELECT cur, prev, pj, min(d) AS d FROM dd GROUP BY 1, 2, 3) GROUP BY 1, 2),
bw AS (SELECT cur, prev, avg(d) AS d FROM (SELECT cur, prev, qj, min(d) AS d FROM dd GROUP BY 1, 2, 3) GROUP BY 1, 2),
cost AS (SELECT cur, prev, round((fw.d + bw.d) / 2, 6) AS cost FROM fw JOIN bw USING (cur, prev))"""


#: Strokes of a block, about; two blocks are compared by one kernel and travel once for all their pairs.
SIDE = 512


def by_blocks(cur: DataFrame, prev: DataFrame, keys: list[str], found: Callable[..., Iterator[pa.RecordBatch]], schema: str, limit: float = np.inf) -> DataFrame:
    """Strokes of ``cur`` against those of ``prev``, both (keys, stroke, p), with the same keys, block by block.

    ``found(key, cur, prev, cost)`` gets the values of the keys, the strokes of two blocks in order and
    the distances as a matrix, infinite from ``limit`` on where that shows without them and NaN for
    strokes without points, and gives batches of ``schema``. Strokes of a key are dealt to blocks by hash.
    """
    spark = cur.sparkSession
    most, groups = cur.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n"), F.count("*")).first()
    k = max(1, -(-(most or 0) // SIDE))
    xy = F.flatten(F.transform("p", lambda q: F.array(q["x"], q["y"]))).alias("xy")
    blocks = lambda s, name: s.groupBy(*keys, F.pmod(F.xxhash64("stroke"), F.lit(k)).alias("part")).agg(F.collect_list(F.struct("stroke", xy)).alias(name)).drop("part")
    pairs = groups * k * k
    parts = max(1, min(pairs, max(4 * spark.sparkContext.defaultParallelism, pairs // 32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                (a, p), (b, q) = (_strokes(batch.column(c)[r].values) for c in ("a", "b"))
                yield from found([batch.column(c)[r].as_py() for c in keys], a, b, kernels.mutual_distances(p, q, limit))

    return blocks(cur, "a").join(blocks(prev, "b"), keys).select(*keys, "a", "b").repartition(parts).mapInArrow(run, schema)


def _strokes(block: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and points (stroke, point, 2) of a block; points that are null or beyond a stroke's end are NaN."""
    ids, xy = block.field("stroke").to_numpy(zero_copy_only=False), block.field("xy")
    n = pc.fill_null(pc.list_value_length(xy), 0).to_numpy(zero_copy_only=False) // 2
    p = np.full((len(ids), n.max(initial=0), 2), np.nan)
    p[np.arange(p.shape[1]) < n[:, None]] = xy.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 2)
    p[np.isnan(p).any(axis=2)] = np.nan
    order = np.argsort(ids)
    return ids[order], p[order]


def rounded(cost: np.ndarray) -> np.ndarray:
    """Costs to six places, halves up, as the SQL rounds them."""
    return np.floor(cost * 1e6 + 0.5) / 1e6


def successive(spark, sf_dir, found: Callable[..., Iterator[pa.RecordBatch]], schema: str, limit: float = np.inf) -> DataFrame:
    """``by_blocks`` of strokes of a kind in successive frames."""
    s = strokes(spark, sf_dir)
    return by_blocks(s, s.withColumn("frame", F.col("frame") + 1), ["frame", "type"], found, schema, limit)


def _xy(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all points of a column of strokes, and where each stroke begins."""
    flat = col.flatten()
    return np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")], 1), np.concatenate([[0], np.cumsum(pc.list_value_length(col).to_numpy(zero_copy_only=False))])


def chamfer(pairs: DataFrame, limit: float | None = None) -> DataFrame:
    """``pairs`` (p, q, any others) with the cost instead of the points: the mean distance of a stroke's points to the other's nearest, both ways averaged.

    With a limit, pairs whose boxes are as far apart go before their distances are computed: every
    point is at least as far away. Strokes may differ in their numbers of points; none is empty.
    """
    if limit is not None:
        edge = lambda s, c, f: f(F.transform(s, lambda v: v[c]))
        gap = lambda c: F.greatest(edge("p", c, F.array_min) - edge("q", c, F.array_max), edge("q", c, F.array_min) - edge("p", c, F.array_max), F.lit(0.0))
        pairs = pairs.where(F.sqrt(gap("x") * gap("x") + gap("y") * gap("y")) < limit)
    kept = [f for f in pairs.schema if f.name not in ("p", "q")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                (p, i), (q, j) = _xy(part.column("p")), _xy(part.column("q"))
                if len(p) == part.num_rows * i[1] and len(q) == part.num_rows * j[1] and (np.diff(i) == i[1]).all() and (np.diff(j) == j[1]).all():
                    u, v = p.reshape(part.num_rows, i[1], 1, 2), q.reshape(part.num_rows, 1, j[1], 2)
                    d = np.sqrt(((u - v) ** 2).sum(axis=3))
                    cost = (d.min(axis=2).mean(axis=1) + d.min(axis=1).mean(axis=1)) / 2
                else:
                    cost = np.empty(part.num_rows)
                    for r in range(part.num_rows):
                        d = np.sqrt(((p[i[r] : i[r + 1], None] - q[None, j[r] : j[r + 1]]) ** 2).sum(axis=2))
                        cost[r] = (d.min(axis=1).mean() + d.min(axis=0).mean()) / 2
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(cost)], [*(f.name for f in kept), "cost"])

    return pairs.select(*(f.name for f in kept), "p", "q").mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", cost double")


@query("chamfer_cost", with_views(_COST.strip() + "\nSELECT cur, prev, cost FROM cost", "poly"))
def chamfer_cost(spark, sf_dir):
    """Mean distance to the nearest point, both ways, between strokes of a kind in successive frames."""

    def run(key: list, cur: np.ndarray, prev: np.ndarray, cost: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(cur), 64):
            c = cur[a : a + 64]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c, len(prev))), pa.array(np.tile(prev, len(c))), pa.array(rounded(cost[a : a + 64]).ravel(), from_pandas=True)], ["cur", "prev", "cost"])

    return successive(spark, sf_dir, run, "cur long, prev long, cost double")


@query("match_quality", with_views(_COST.strip() + ",\nr AS (SELECT cur, cost, row_number() OVER (PARTITION BY cur ORDER BY cost, prev) AS r FROM cost)\nSELECT a.cur, a.cost AS best, round(b.cost / a.cost, 4) AS ratio FROM r a LEFT JOIN r b ON b.cur = a.cur AND b.r = 2 WHERE a.r = 1", "poly"))
def match_quality(spark, sf_dir):
    """How much worse the second best match of a stroke is. A block sends the two best of its own."""

    def run(key: list, cur: np.ndarray, prev: np.ndarray, cost: np.ndarray) -> Iterator[pa.RecordBatch]:
        two = np.sort(np.partition(rounded(cost), min(1, len(prev) - 1), axis=1)[:, :2], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cur, two.shape[1])), pa.array(two.ravel(), from_pandas=True)], ["cur", "cost"])

    two = successive(spark, sf_dir, run, "cur long, cost double").groupBy("cur").agg(F.array_sort(F.collect_list("cost")).alias("c"))
    best, second = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    by_zero = F.when(second > 0, float("inf")).when(second == 0, float("nan"))  # as the SQL divides
    return two.select("cur", best.alias("best"), F.when(best == 0, by_zero).otherwise(F.round(second / F.nullif(best, F.lit(0.0)), 4)).alias("ratio"))


@query("nearest_match", with_views(_COST.strip() + "\nSELECT cur, arg_min(prev, (cost, prev)) AS prev FROM cost WHERE cost < 18 GROUP BY 1", "poly"))
def nearest_match(spark, sf_dir):
    """The previous frame's nearest stroke, below a limit. A block sends the best of its own."""

    def run(key: list, cur: np.ndarray, prev: np.ndarray, cost: np.ndarray) -> Iterator[pa.RecordBatch]:
        c = rounded(np.where(np.isnan(cost), np.inf, cost))
        best = c.argmin(axis=1)
        c = c[np.arange(len(cur)), best]
        near = c < 18
        yield pa.RecordBatch.from_arrays([pa.array(cur[near]), pa.array(prev[best[near]]), pa.array(c[near])], ["cur", "prev", "cost"])

    return successive(spark, sf_dir, run, "cur long, prev long, cost double", 18.0).groupBy("cur").agg(F.min(F.struct("cost", "prev")).alias("b")).select("cur", "b.prev")


def matched(cur: DataFrame, prev: DataFrame, keys: list[str], limit: float, round_first: bool) -> DataFrame:
    """(keys, cur, prev, cost) one-to-one: as many as possible below the limit, of the smallest total cost.

    Strokes with other keys are never matched, so each key is a problem of its own. Costs travel as
    matrices of blocks, four bytes a pair; a key's whole matrix is in one task.
    """
    if limit * 1e6 >= 1 << 31:
        raise ValueError("costs in millionths must fit 32 bits")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cur.select(*keys).schema)
    arrow = [f.type for f in to_arrow_schema(cur.select(*keys).schema)]

    def run(key: list, a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> Iterator[pa.RecordBatch]:
        r = rounded(cost)
        with np.errstate(invalid="ignore"):
            ok = (r if round_first else cost) < limit
        c = np.where(ok, np.rint(np.where(ok, r, 0) * 1e6), -1).astype(np.int32)
        if ok.any():
            yield pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(key, arrow, strict=True)), pa.array([a], pa.list_(pa.int64())), pa.array([b], pa.list_(pa.int64())), pa.array([c.tobytes()], pa.binary())], [*keys, "a", "b", "c"])

    def best(group: pa.Table) -> pa.Table:
        a, b = ([x.values.to_numpy() for x in group.column(c)] for c in ("a", "b"))
        cur, prev = np.unique(np.concatenate(a)), np.unique(np.concatenate(b))
        c = np.full((len(cur), len(prev)), -1, np.int32)
        for x, y, block in zip(a, b, group.column("c"), strict=True):
            c[np.ix_(np.searchsorted(cur, x), np.searchsorted(prev, y))] = np.frombuffer(block.as_buffer(), np.int32).reshape(len(x), len(y))
        i, j = np.array(kernels.assign_whole(c), int).reshape(-1, 2).T
        return pa.table([*(pa.array([group.column(k)[0].as_py()] * len(i), group.schema.field(k).type) for k in keys), pa.array(cur[i]), pa.array(prev[j]), pa.array(c[i, j] / 1e6)], [*keys, "cur", "prev", "cost"])

    blocks = by_blocks(cur, prev, keys, run, kinds + ", a array<long>, b array<long>, c binary", limit)
    return blocks.groupBy(*keys).applyInArrow(best, kinds + ", cur long, prev long, cost double")


@query("assign_tracks")
def assign_tracks(spark, sf_dir):
    """One-to-one matches of a frame's strokes with the last frame's: the smallest total cost, below a limit."""
    s = strokes(spark, sf_dir)
    return matched(s, s.withColumn("frame", F.col("frame") + 1), ["frame", "type"], 18.0, True).select("frame", "cur", "prev", "cost")


@query("nearest_point", with_views("SELECT stroke, arg_min(j, ((x - 3) * (x - 3) + (y + 2) * (y + 2), y, x, j)) AS j FROM poly GROUP BY 1", "poly"))
def nearest_point(spark, sf_dir):
    d = (F.col("x") - 3) * (F.col("x") - 3) + (F.col("y") + 2) * (F.col("y") + 2)
    return poly(spark, sf_dir).groupBy("stroke").agg(F.min_by("j", F.struct(d, "y", "x", "j")).alias("j"))


_R = 2.0


@query("free_ends", with_views(f"""
e AS (SELECT * FROM poly WHERE j IN (0, 31))
SELECT e.stroke, e.j, NOT EXISTS (SELECT 1 FROM poly o WHERE o.frame = e.frame AND o.stroke <> e.stroke AND (o.x - e.x) * (o.x - e.x) + (o.y - e.y) * (o.y - e.y) <= {_R * _R}) AS free FROM e""", "poly"))
def free_ends(spark, sf_dir):
    """Ends with no other stroke of the frame within reach: an equi-join on square buckets of that size and their neighbours."""
    cell = lambda c: F.floor(F.col(c) / _R)
    p = poly(spark, sf_dir)
    ends = p.where("j in (0, 31)").select("stroke", "j", "frame", "x", "y", F.explode(F.sequence(cell("x") - 1, cell("x") + 1)).alias("cx"), cell("y").alias("cy0"))
    ends = ends.select("*", F.explode(F.sequence(F.col("cy0") - 1, F.col("cy0") + 1)).alias("cy"))
    others = p.select(F.col("frame"), F.col("stroke").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), cell("x").alias("cx"), cell("y").alias("cy"))
    near = (F.col("ox") - F.col("x")) * (F.col("ox") - F.col("x")) + (F.col("oy") - F.col("y")) * (F.col("oy") - F.col("y")) <= _R * _R
    met = ends.join(others, ["frame", "cx", "cy"]).where((F.col("other") != F.col("stroke")) & near).select("stroke", "j", F.lit(True).alias("met")).distinct()
    return p.where("j in (0, 31)").select("stroke", "j").join(met, ["stroke", "j"], "left").select("stroke", "j", F.col("met").isNull().alias("free"))


@query("main_silhouette", with_views(_AREA + ",\nt AS (SELECT stroke, any_value(frame) AS frame, any_value(type) AS type FROM poly GROUP BY 1), b AS (SELECT frame, stroke, row_number() OVER (PARTITION BY frame ORDER BY abs(round(a, 3)) DESC, stroke) AS r FROM area JOIN t USING (stroke) WHERE type = 0)\nSELECT frame, stroke, lag(stroke) OVER (ORDER BY frame) AS inherits FROM b WHERE r = 1", "poly"))
def main_silhouette(spark, sf_dir):
    """The largest outline of each frame and the one it takes its id from. A row for each frame reaches the last window."""
    s = strokes(spark, sf_dir).where("type = 0").select("frame", "stroke", F.abs(F.round(signed("p"), 3)).alias("a"))
    best = s.groupBy("frame").agg((-F.max(F.struct("a", (-F.col("stroke")).alias("s")))["s"]).alias("stroke"))
    return best.withColumn("inherits", F.lag("stroke").over(Window.orderBy("frame")))


@query("jobs_by_shot", with_views("""
p AS (SELECT clip, i, 1 + (v::BIGINT % 3) AS target, (k <> 'error')::INT AS label FROM seq), s AS (SELECT clip, i // 20 AS shot, min(i) AS lo, max(i) AS hi FROM seq GROUP BY 1, 2)
SELECT s.clip, s.shot, target, s.lo, s.hi, string_agg(p.i || ':' || label, ' ' ORDER BY p.i) AS prompts FROM p JOIN s ON s.clip = p.clip AND p.i BETWEEN s.lo AND s.hi GROUP BY ALL""".replace("v::BIGINT", "floor(v)::BIGINT"), "seq"))
def jobs_by_shot(spark, sf_dir):
    """Prompts by the shot they lie in and their target, in order of frame."""
    q = seq(spark, sf_dir)
    by_shot = Window.partitionBy("clip", "shot")
    q = q.withColumn("shot", F.floor(F.col("i") / 20)).withColumn("lo", F.min("i").over(by_shot)).withColumn("hi", F.max("i").over(by_shot))
    q = q.withColumn("target", 1 + F.floor("v") % 3)
    g = q.groupBy("clip", "shot", "target", "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("i", (F.col("k") != "error").cast("int").alias("label")))).alias("p"))
    return g.select("clip", "shot", "target", "lo", "hi", F.array_join(F.transform("p", lambda r: F.concat(r["i"].cast("string"), F.lit(":"), r["label"].cast("string"))), " ").alias("prompts"))


@query("frame_kinds", with_views("""
f AS (SELECT clip, min(i) FILTER (WHERE k = 'click') AS first FROM seq GROUP BY 1)
SELECT clip, i, CASE WHEN k = 'click' THEN 'prompt' WHEN first IS NULL THEN 'none' WHEN i > first THEN 'forward' ELSE 'backward' END AS kind FROM seq JOIN f USING (clip)""", "seq"))
def frame_kinds(spark, sf_dir):
    """What a frame's mask comes from: a prompt, forward from the first prompt, or backward."""
    first = F.min(F.when(F.col("k") == "click", F.col("i"))).over(Window.partitionBy("clip"))
    s = seq(spark, sf_dir).withColumn("first", first)
    return s.select("clip", "i", F.when(F.col("k") == "click", "prompt").when(F.col("first").isNull(), "none").when(F.col("i") > F.col("first"), "forward").otherwise("backward").alias("kind"))


@query("pop_energy", with_views("""
l AS (SELECT stroke % 37 AS id, frame, type, sum(d) AS len FROM (SELECT a.stroke, a.frame, a.type, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM poly a JOIN poly b ON b.stroke = a.stroke AND b.j = a.j + 1) GROUP BY ALL),
t AS (SELECT frame, type, sum(len) AS total FROM l GROUP BY 1, 2),
born AS (SELECT a.frame, a.type, sum(a.len) AS len FROM l a WHERE a.frame > 0 AND NOT EXISTS (SELECT 1 FROM l b WHERE b.frame = a.frame - 1 AND b.type = a.type AND b.id = a.id) GROUP BY 1, 2)
SELECT t.frame, t.type, round(coalesce(born.len, 0) / t.total, 4) AS share FROM t LEFT JOIN born USING (frame, type)""", "poly"))
def pop_energy(spark, sf_dir):
    """Share of a frame's stroke length, by kind, in tracks that weren't there the frame before."""
    from framewright.plans.polyline import lengths, total

    l = strokes(spark, sf_dir).select((F.col("stroke") % 37).alias("id"), "frame", "type", total(lengths("p")).alias("len")).groupBy("id", "frame", "type").agg(F.sum("len").alias("len"))
    before = l.select("id", "type", (F.col("frame") + 1).alias("frame"), F.lit(True).alias("was"))
    l = l.join(before, ["id", "type", "frame"], "left")
    born = F.when(F.col("was").isNull() & (F.col("frame") > 0), F.col("len")).otherwise(0.0)
    return l.groupBy("frame", "type").agg(F.round(F.sum(born) / F.sum("len"), 4).alias("share"))


@query("track_ages", with_views("""
t AS (SELECT DISTINCT stroke % 37 AS id, frame FROM poly), g AS (SELECT id, frame, frame - row_number() OVER (PARTITION BY id ORDER BY frame) AS isle FROM t)
SELECT id, min(frame) AS born, count(*) AS age FROM g GROUP BY id, isle""", "poly"))
def track_ages(spark, sf_dir):
    """Unbroken lives of each track id."""
    t = strokes(spark, sf_dir).select((F.col("stroke") % 37).alias("id"), "frame").distinct()
    t = t.withColumn("isle", F.col("frame") - F.row_number().over(Window.partitionBy("id").orderBy("frame")))
    return t.groupBy("id", "isle").agg(F.min("frame").alias("born"), F.count("*").alias("age")).drop("isle")


@query("duplicate_ids", with_views("SELECT frame, id, count(*) AS n FROM (SELECT DISTINCT stroke, frame, stroke % 7 AS id FROM poly) GROUP BY 1, 2 HAVING count(*) > 1", "poly"))
def duplicate_ids(spark, sf_dir):
    return strokes(spark, sf_dir).groupBy("frame", (F.col("stroke") % 7).alias("id")).agg(F.count("*").alias("n")).where("n > 1")


@query("gap_histogram", with_views("""
e AS (SELECT a.stroke, a.frame, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS gap FROM poly a JOIN poly b ON b.stroke = a.stroke AND a.j = 0 AND b.j = 31), bins(lo, hi) AS (VALUES (0, 10), (10, 20), (20, 30), (30, 1000))
SELECT lo, hi, count(*) AS n FROM e JOIN bins ON gap >= lo AND gap < hi GROUP BY 1, 2""", "poly"))
def gap_histogram(spark, sf_dir):
    a, b = F.get("p", F.lit(0)), F.get("p", F.lit(31))
    gap = F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
    lo = F.when(gap < 10, 0).when(gap < 20, 10).when(gap < 30, 20).otherwise(30)
    return strokes(spark, sf_dir).withColumn("lo", lo).groupBy("lo").agg(F.count("*").alias("n")).select("lo", F.when(F.col("lo") == 30, 1000).otherwise(F.col("lo") + 10).alias("hi"), "n")
