"""Near-duplicate embeddings by a pivot-permutation index.

Every vector is described by its ``k`` nearest reference points in order. The inverted lists are kept
by pairs of pivots, so that meeting in a list means sharing two pivots at least: the shared-pivot
count that retrieval asks for. The order decides which pairs count: the places of the two in the
permutation, from 0, add up to ``reach`` at most, so a far pivot counts only beside a near one.

The lists hold ids and a sketch of 128 signs of random projections, no vectors. Long lists are cut
into blocks and blocks are paired, so no task holds more than two blocks. Entries that have another
one within the sketch's bound are kept (a pair at the threshold fails it with a probability of about
1e-4); only theirs are the vectors sent, once to each list, and compared in double precision. A pair
is reported by the smallest of the lists that it shares, hence once. Tasks report sums of links and
a spanning forest, never the pairs. Equal vectors are one entry with a count.

Pivots: a sample of at most 4 x ``most_pivots`` vectors, spread out by dropping those near another;
their number grows as the root of the number of vectors up to ``most_pivots``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import arrow, connected_components, durable, table, with_small

BLOCK = 1024
#: Signs in a sketch.
BITS = 128


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, wanted: int, apart: float) -> np.ndarray:
    """The first ``wanted`` vectors of the sample that aren't nearer than ``apart`` (a cosine) to one chosen before."""
    chosen, n = np.empty((min(wanted, len(sample)), sample.shape[1])), 0
    for x in sample:
        if not n or float((chosen[:n] @ x).max()) < apart:
            chosen[n] = x
            n += 1
        if n == wanted:
            break
    return chosen[:n]


def nearest(unit: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The ids of the k nearest pivots, nearest first; equally near ones by id."""
    return np.argsort(-np.round(unit @ pivots.T, 12), axis=1, kind="stable")[:, :k]


def lists(near: np.ndarray, n_pivots: int, reach: int) -> np.ndarray:
    """For each row of ordered pivots the numbers of its lists."""
    if n_pivots == 1:
        return np.zeros((len(near), 1), np.int64)
    places = [(i, j) for i, j in combinations(range(near.shape[1]), 2) if i + j <= max(reach, 1)]
    a, b = near[:, [i for i, _ in places]], near[:, [j for _, j in places]]
    return np.minimum(a, b) * n_pivots + np.maximum(a, b)


def _bound(least: float) -> int:
    """How many signs may differ: a pair at the threshold has more with a probability of about 1e-4."""
    p = math.acos(min(1.0, max(-1.0, least))) / math.pi
    return math.ceil(BITS * p - NormalDist().inv_cdf(1e-4) * math.sqrt(BITS * p * (1 - p)))


def _links(x: np.ndarray, own: np.ndarray, first: int, least: float, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j, i in the first ``first`` rows and j after them (or, if all rows are one block, any), that list ``key`` has to report."""
    n = len(x)
    whole = first == n
    out_i, out_j = [], []
    for a in range(0, first, 256):
        c = x[a : min(a + 256, first)] @ (x if whole else x[first:]).T
        i, j = np.nonzero(c >= least)
        i, j = i + a, j + (0 if whole else first)
        if whole:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 16384):
            p, q = i[s : s + 16384], j[s : s + 16384]
            smaller = own[p] < key  # no list below this one may hold both
            ok = ~((own[p][:, :, None] == own[q][:, None, :]).any(axis=2) & smaller).any(axis=1)
            out_i.append(p[ok])
            out_j.append(q[ok])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.empty(0, int), np.empty(0, int))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(embeddings: DataFrame, least: float = 0.9, k: int = 10, reach: int = 9, most_pivots: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``embeddings`` (vec_id, embedding, any others).

    Vectors link at a cosine of ``least`` or more if they share two of their ``k`` nearest pivots whose
    places add up to ``reach`` at most in both.
    Null, empty or zero vectors, and those with null or non-finite components, link with nothing;
    vectors of different lengths don't link. Rows that repeat id and vector are one vector; rows of
    one id with different vectors are different vectors of one component. A null id links with
    nothing, has component_id null and is kept.
    """
    kind = embeddings.schema["embedding"].dataType
    kind = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    good = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = durable(rows.withColumn("v", F.when(F.coalesce(good, F.lit(False)) & F.col("vec_id").isNotNull(), F.transform("v", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x)))))
    whole = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("m"))
    whole = durable(whole.select(F.xxhash64("v", F.lit(7)).alias("cid"), F.xxhash64("v", F.lit(8)).alias("cid2"), "rep", "m", "v"))
    dims = [r[0] for r in whole.groupBy(F.size("v").alias("d")).count().collect()]
    parts = [_of_length(whole.where(F.size("v") == d), d, least, k, reach, most_pivots) for d in dims]
    member = rows.where("v is not null").select("vec_id", F.xxhash64("v", F.lit(7)).alias("cid"), F.xxhash64("v", F.lit(8)).alias("cid2")).distinct().join(whole.select("cid", "cid2", "rep", "m"), ["cid", "cid2"])
    edges, counts = member.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")), None
    for found in parts:
        edges = edges.unionAll(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
        n = found.where("n > 0").groupBy("cid", "cid2").agg(F.sum("n").alias("far"))
        counts = n if counts is None else counts.unionAll(n)
    if counts is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    comp = connected_components(edges)
    own = member.join(counts, ["cid", "cid2"], "left").groupBy("vec_id").agg(F.sum(F.col("m") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    return (
        rows.select("vec_id")
        .join(own, "vec_id", "left")
        .join(comp.withColumnRenamed("id", "vec_id"), "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
    )


def _vectors(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Whole cells of a stream sorted by ``cell``, many at a time, and where they begin and end."""
    held: pa.Table | None = None

    def cut(t: pa.Table) -> tuple[pa.Table, list[int]]:
        cell = t.column("cell").to_numpy()
        return t.combine_chunks(), [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        cell = t.column("cell").to_numpy()
        last = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
        held = t.slice(last)
        if last:
            yield cut(t.slice(0, last))
    if held is not None and held.num_rows:
        yield cut(held)


def _of_length(whole: DataFrame, dims: int, least: float, k: int, reach: int, most_pivots: int) -> DataFrame:
    """(cid, cid2, rep, n, other): links counted for an entry, and the representative it hangs from in a task's forest."""
    total = whole.count()
    wanted = int(min(most_pivots, max(32, math.sqrt(total))))
    sample = np.array([r[0] for r in whole.orderBy(F.xxhash64("cid", F.lit("pivot")), "cid2").select("v").limit(4 * wanted).collect()], float)
    pivots = choose_pivots(_unit(sample), wanted, 0.8)
    shared = whole.sparkSession.sparkContext.broadcast((pivots, np.random.default_rng(1).normal(size=(dims, BITS))))  # at most most_pivots rows and BITS columns
    n_pivots, k, bound = len(pivots), min(k, len(pivots)), _bound(least)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, planes = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                unit = _unit(_vectors(part.column("v")))
                sketch = np.packbits(unit @ planes > 0, axis=1).view(np.int64)
                own = lists(nearest(unit, pivots, k), n_pivots, reach)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), pa.array(list(own), pa.list_(pa.int64()))], [*part.schema.names, "s1", "s2", "lists"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.select("cid", "cid2", "rep", "m", "v").schema)
    described = durable(arrow(whole.select("cid", "cid2", "rep", "m", "v"), describe, f"{fields}, s1 long, s2 long, lists array<long>"))
    listed = described.select("cid", "s1", "s2", F.explode("lists").alias("key"))
    sizes = durable(listed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    entry = listed.join(with_small(sizes, sizes.count(), 24), "key")
    mine = F.pmod(F.xxhash64("cid", "key"), F.col("blocks")).cast("int")
    place = lambda o: F.struct(
        F.xxhash64("key", F.least(F.col("mine"), o), F.greatest(F.col("mine"), o)).alias("cell"), F.when(o == F.col("mine"), 0).when(F.col("mine") < o, 1).otherwise(2).alias("side")
    )
    dealt = entry.withColumn("mine", mine).select("key", "cid", "s1", "s2", F.inline(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), place)))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _runs(batches):
            cell, side = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), t.column("side").to_numpy()
            s1, s2 = (t.column(c).to_numpy().view(np.uint64) for c in ("s1", "s2"))
            flag, i, off = np.zeros(len(cell), bool), np.arange(len(cell)), 1
            while len(i := i[i + off < len(cell)]) and len(i := i[cell[i] == cell[i + off]]):
                j = i + off
                ok = ((side[i] == 0) | (side[i] != side[j])) & (np.bitwise_count(s1[i] ^ s1[j]).astype(np.int16) + np.bitwise_count(s2[i] ^ s2[j]) <= bound)
                flag[i[ok]] = flag[j[ok]] = True
                off += 1
            if flag.any():
                keep = pa.array(flag)
                yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks().filter(keep) for c in ("cell", "side", "key", "cid")], ["cell", "side", "key", "cid"])

    in_reach = durable(arrow(dealt.repartition("cell").sortWithinPartitions("cell"), sketched, "cell long, side int, key long, cid long"))

    def run_of(t: pa.Table) -> list[pa.RecordBatch]:
        n = t.num_rows
        key, side = t.column("key")[0].as_py(), t.column("side").to_numpy()
        first = int((side == 1).sum()) if side[0] else n
        if n < 2 or side[0] and first in (0, n):
            return []
        x = _unit(_vectors(t.column("v").combine_chunks()))
        own = np.array(t.column("lists").to_pylist(), np.int64)
        i, j = _links(x, own, first, least, key)
        if not len(i):
            return []
        m = t.column("m").to_numpy()
        far = np.bincount(i, m[j], n) + np.bincount(j, m[i], n)
        root = _forest(n, i, j)
        rep = t.column("rep").to_numpy()
        use = np.flatnonzero(far > 0)
        other = rep[root[use]]
        return [
            pa.RecordBatch.from_arrays(
                [t.column("cid").combine_chunks().take(use), t.column("cid2").combine_chunks().take(use), pa.array(rep[use]), pa.array(far[use].astype(np.int64)), pa.array(other, pa.int64())], ["cid", "cid2", "rep", "n", "other"]
            )
        ]

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _runs(batches):
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield from run_of(t.slice(a, b - a))

    sent = in_reach.join(described.select("cid", "cid2", "rep", "m", "v", "lists"), "cid").repartition("cell").sortWithinPartitions("cell", "side")
    return durable(arrow(sent.select("cell", "side", "key", "cid", "cid2", "rep", "m", "v", "lists"), verified, "cid long, cid2 long, rep long, n long, other long"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
