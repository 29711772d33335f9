"""Frame-shaped views of the driver's tables, as DataFrames and as SQL common table expressions.

The grid is 24 frames of 10 x 16 cells with four groups (0 is background); a clip is one user's
events in order; a stroke is an embedding read as 32 points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAMES, HEIGHT, WIDTH, GROUPS = 24, 10, 16, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cell(df: DataFrame) -> DataFrame:
    return df.select(
        (F.col("l_orderkey") % FRAMES).cast("int").alias("frame"),
        (F.col("l_suppkey") % HEIGHT).cast("int").alias("y"),
        (F.col("l_partkey") % WIDTH).cast("int").alias("x"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).when(F.col("l_linestatus") == "O", 3).otherwise(0).alias("g"),
        F.col("l_quantity").alias("quantity"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
    )


def grid(spark: SparkSession, groups: int = 1) -> DataFrame:
    """Every cell once for each group."""
    i = F.col("id")
    return spark.range(FRAMES * HEIGHT * WIDTH * groups).select(
        (i / (HEIGHT * WIDTH * groups)).cast("int").alias("frame"), ((i / (WIDTH * groups)).cast("int") % HEIGHT).alias("y"), ((i / groups).cast("int") % WIDTH).alias("x"), (i % groups).cast("int").alias("g")
    )


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, y, x, g, s): dense group sums."""
    sums = _cell(table(spark, sf_dir, "lineitem")).groupBy("frame", "y", "x", "g").agg(F.sum("quantity").cast("long").alias("s"))
    return grid(spark, GROUPS).join(F.broadcast(sums), ["frame", "y", "x", "g"], "left").select("frame", "y", "x", "g", F.coalesce("s", F.lit(0)).cast("long").alias("s"))  # at most one row a cell and group


def gmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, y, x, g): the group of the largest sum, of equal ones the smallest."""
    best = px(spark, sf_dir).groupBy("frame", "y", "x").agg(F.max(F.struct("s", (-F.col("g")).alias("g"))).alias("b"))
    return best.select("frame", "y", "x", (-F.col("b.g")).cast("int").alias("g"))


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, y, x, d)."""
    sums = _cell(table(spark, sf_dir, "lineitem")).groupBy("frame", "y", "x").agg(F.sum("cents").alias("c"))
    return grid(spark).drop("g").join(F.broadcast(sums), ["frame", "y", "x"], "left").select("frame", "y", "x", (F.coalesce("c", F.lit(0)) / 100000.0 + 1).alias("d"))


def seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, i, v, k): each user's events, numbered from 0 in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), (F.row_number().over(order) - 1).cast("int").alias("i"), F.col("value").alias("v"), F.col("event_type").alias("k"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq(spark, sf_dir).select("clip", "i", F.floor(F.col("v") / 100).cast("int").alias("n"))


def poly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stroke, type, frame, j, x, y): 32 points a stroke."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("stroke"), (F.col("label") % 4).alias("type"), (F.col("vec_id") % 20).cast("int").alias("frame"), F.col("embedding").cast("array<double>").alias("e"))
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.struct(F.round(F.get("e", j * 2) * 100, 3).alias("x"), F.round(F.get("e", j * 2 + 1) * 100, 3).alias("y"))))
    return e.select("stroke", "type", "frame", at.alias("j", "p")).select("stroke", "type", "frame", "j", "p.x", "p.y")


_CTE = {
    "cell": (
        [],
        "SELECT (l_orderkey % 24)::INT AS frame, (l_suppkey % 10)::INT AS y, (l_partkey % 16)::INT AS x, CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 2 WHEN l_linestatus = 'O' THEN 3 ELSE 0 END AS g, l_quantity AS quantity, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem",
    ),
    "grid": ([], "SELECT f.i::INT AS frame, r.i::INT AS y, c.i::INT AS x FROM range(24) f(i), range(10) r(i), range(16) c(i)"),
    "px": (["cell", "grid"], "SELECT grid.frame, grid.y, grid.x, gs.i::INT AS g, coalesce(q.s, 0)::BIGINT AS s FROM grid CROSS JOIN range(4) gs(i) LEFT JOIN (SELECT frame, y, x, g, sum(quantity)::BIGINT AS s FROM cell GROUP BY ALL) q ON q.frame = grid.frame AND q.y = grid.y AND q.x = grid.x AND q.g = gs.i"),
    "gmap": (["px"], "SELECT frame, y, x, g FROM (SELECT *, row_number() OVER (PARTITION BY frame, y, x ORDER BY s DESC, g) AS r FROM px) WHERE r = 1"),
    "depth": (["cell", "grid"], "SELECT frame, y, x, coalesce(c, 0) / 100000.0::DOUBLE + 1 AS d FROM grid LEFT JOIN (SELECT frame, y, x, sum(cents)::BIGINT AS c FROM cell GROUP BY ALL) USING (frame, y, x)"),
    "seq": ([], "SELECT user_id AS clip, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS i, value AS v, event_type AS k FROM events"),
    "runs": (["seq"], "SELECT clip, i, floor(v / 100)::INT AS n FROM seq"),
    "poly": ([], "SELECT stroke, type, frame, j, round(e[2 * j + 1]::DOUBLE * 100, 3) AS x, round(e[2 * j + 2]::DOUBLE * 100, 3) AS y FROM (SELECT vec_id AS stroke, label % 4 AS type, (vec_id % 20)::INT AS frame, embedding AS e, unnest(range(32))::INT AS j FROM embeddings)"),
}


def with_views(sql: str, *names: str) -> str:
    """``sql``, which starts with a WITH list entry or SELECT, behind the named views and those they need."""
    out: dict[str, str] = {}

    def need(name: str) -> None:
        for x in _CTE[name][0]:
            need(x)
        out[name] = _CTE[name][1]

    for name in names:
        need(name)
    head = ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in out.items())
    body = sql.strip()
    return f"WITH RECURSIVE {head}\n{body}" if body.upper().startswith("SELECT") else f"WITH RECURSIVE {head},\n{body}"
