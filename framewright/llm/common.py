"""What several operators share: durable cuts of the lineage, connected components, tables."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A side of a join is broadcast below this many bytes only; its size is measured first.
BROADCAST_BYTES = 32 << 20
#: Rows of a batch between the JVM and Python.
ARROW_ROWS = 1000
#: Up to so many distinct edges (16 bytes each) one task joins them to components; beyond, all tasks do, in rounds.
FEW_EDGES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the folder that all executors share.

    The folder is the cluster's ``spark.checkpoint.dir``. Only a local session without that setting
    (tests) gets a folder of its own; on a cluster without it this is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not (where := sc.getConf().get("spark.checkpoint.dir")):
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            where = tempfile.mkdtemp(prefix="framewright-checkpoint-")
        sc.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` in batches of ``ARROW_ROWS`` rows, which bounds what a worker and its JVM hold of long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df.mapInArrow(run, schema)


def with_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Mark a counted side for broadcast if its measured size is under the bound; else leave the join to shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all the edges (u, v) of one task: every id takes the smallest label around it, and labels their own label, until nothing changes."""
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not parts:
        return
    u, v = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        low, new = np.minimum(label[i], label[j]), label.copy()
        for end in (i, j):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["id", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable from each id that occurs in an edge.

    Alternating large-star and small-star steps. Each step takes minima by a map-side combined
    aggregate and joins them back, so that a hub with any number of neighbours is split over tasks
    (skew join) and never gathered. Every round ends in a checkpoint; rounds grow as the logarithm
    of the longest chain. Ids are non-null longs; self edges and repeats are allowed. At most
    ``FEW_EDGES`` distinct edges, counted first, are joined by one task instead, which saves the rounds.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    cur = durable(edges.select(hi.alias("u"), lo.alias("v")).where("u <> v").distinct())
    if cur.count() <= FEW_EDGES:
        return arrow(cur.coalesce(1), _joined, "id long, component long")
    seen = None
    while True:
        mark = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        if not mark[0]:
            break
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        cur = durable(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
    roots = cur.select(F.col("v").alias("id")).distinct()
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots.select("id", F.col("id").alias("component")))


def crc_mod(doc_id: Column | str, by: int) -> Column:
    """crc32 of the id's decimal text, modulo ``by``; null ids count as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % by
