"""Near-duplicate documents by a chosen-path set similarity join.

Documents with equal shingle sets are one class. Every independent tree sends a class down a path:
the node reached so far picks one of the minwise coordinates, and the class's minwise token at that
coordinate picks the child. A pair of Jaccard similarity s stays together for one level with
probability s. A node stops branching once it has ``small`` members or is ``depth`` levels deep.

Small nodes are compared exhaustively, in two steps that emit members and links but never pairs:
first sketches, which leave the members that have a partner in reach; then the full sets of those,
sent to the node once, where components grow in a union-find. The first two trees are compared
first. In the others a node whose members are all in one component goes no further, and only members
count whose partner is in another one, so that a group that is joined costs nothing more. A node
that is still large at the last level has its members compared with one leader; those outside the
node's largest component then meet all its members in blocks. No node is cut, sampled or skipped.

A pair of similarity s agrees in a of the 64 coordinates, a binomial in s, and the trees of a group
draw from the same coordinates. A pair that stays in a large node until level d is then missed by a
group of T trees with probability E[(1 - (a/64)^d)^T]: for s = 0.85 and 8 trees 2e-6 at level 1,
1.5e-4 at 2, 1.6e-3 at 3, 11 % at 8; for s = 0.8 1e-5, 8e-4, 7e-3 and 25 %. Classes in a node that is
large at a level where this exceeds ``MISSED`` therefore go down further groups of trees, each with
64 coordinates of its own, as many as the deepest level reached calls for.

Partners are in reach if a size bound (exact) holds and so many of 64 one-byte minwise tokens agree
that a pair at the threshold fails with a probability under 1e-4; the full sets (48 bits of each
shingle) decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm import wordhash as W
from framewright.llm.common import arrow, connected_components, durable, table, with_small

COORDINATES = 64
#: Members of a node that a task compares at once; larger nodes are cut into blocks of this size.
BLOCK = 2048
#: Shingles that weigh as much as one member.
WEIGHT = 4096
#: Trees that are compared before the others.
AHEAD = 2
#: Probability at which the trees may miss a pair at the threshold.
MISSED = 1e-3
_ONES = np.uint64(0x0101010101010101)
LEAF = ("node", "cid", "doc", "name", "n", "sk", "size")


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = W.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return a, W.mix(a)


def _missed(level: int, trees: int, s: float) -> float:
    """Probability that a group of trees misses a pair that stays in large nodes until this level."""
    n = COORDINATES
    return sum(math.comb(n, a) * s**a * (1 - s) ** (n - a) * (1 - (a / n) ** level) ** trees for a in range(n + 1))


def _bar(s: float, of: int) -> int:
    """How many of ``of`` sketch bytes must agree: a pair at the threshold has fewer with a probability under 5e-5."""
    fewer = lambda b: sum(math.comb(of, a) * s**a * (1 - s) ** (of - a) for a in range(b))
    return max(b for b in range(of) if fewer(b) < 5e-5)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    data, off = W.utf8(batch.column("text"))
    for i, j in W.chunks(off):
        words, at = W.word_hashes(data, off[i : j + 1])
        for r in range(i, j):
            yield r, W.shingles(words[at[r - i] : at[r - i + 1]], k)


def _class_id(u: np.ndarray) -> bytes:
    """128 bits of a set, independent of any order."""
    return np.array([W.mix(u).sum(dtype=np.uint64), W.mix(u ^ np.uint64(0xABCDEF0123456789)).sum(dtype=np.uint64) + np.uint64(len(u))], np.uint64).tobytes()


def profiles(docs: DataFrame, k: int, first: int = 0, groups: int = 1) -> DataFrame:
    """(doc_id, n_shingles, cid, sig, sk): size, identity and minwise tokens of each text's shingle set, from group ``first`` of the coordinates on."""
    a, b = (x[first * COORDINATES :] for x in _seeds((first + groups) * COORDINATES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cid, sig, sk = [], [], [], []
            for _, u in _sets(batch, k):
                n.append(len(u))
                cid.append(_class_id(u))
                if not len(u):
                    sig.append(None)
                    sk.append(None)
                    continue
                low = np.empty(len(a), np.uint64)
                for x in range(0, len(u), 8192):
                    part = (u[x : x + 8192][:, None] * a + b).min(axis=0)
                    low = part if not x else np.minimum(low, part)
                low = W.mix(low)
                sig.append((low >> np.uint64(32)).astype(np.uint32).view(np.int32))
                sk.append((low[:COORDINATES] & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cid, pa.binary()), pa.array(sig, pa.list_(pa.int32())), pa.array(sk, pa.binary())], ["doc_id", "n_shingles", "cid", "sig", "sk"]
            )

    return arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_shingles long, cid binary, sig array<int>, sk binary")


def _weight(n: str = "n") -> Column:
    """Size of a group of classes: their number, or more if their sets are very large."""
    return F.greatest(F.count("*"), F.ceil(F.sum(n) / WEIGHT))


def _leaves(classes: DataFrame, trees: int, first: int, last: int, small: int, depth: int, sound: int, group: int = 0) -> tuple[DataFrame, int, DataFrame | None]:
    """(node, cid, doc, name, n, sk, size): members of all nodes of the trees ``first`` to ``last`` at which branching ended and that hold two names or more.

    ``classes`` has the coordinates from those of ``group`` on. With it the deepest level, and the
    classes that were in a large node at level ``sound`` and went on from there (None if none did).
    """
    base = (F.floor(F.col("tree") / trees) - group) * COORDINATES + 1
    token = lambda at: F.element_at("sig", (base + at).cast("int"))
    rows = classes.select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("tree"), "*").select("tree", F.xxhash64("tree", token(F.col("tree") % trees % COORDINATES)).alias("node"), "cid", "doc", "name", "n", "sk")
    done, deep, level = [], None, 1
    while True:
        nodes = rows.groupBy("node").agg(_weight().alias("size"), F.min("name").alias("lo"), F.max("name").alias("hi")).where("lo <> hi").select("node", "size")
        members = durable(rows.join(nodes, "node"))
        leaf = F.col("size") <= small
        wide = members.where(~leaf)
        more = level < depth and bool(wide.take(1))
        done.append((members.where(leaf) if more else members).select(*LEAF))
        if not more:
            break
        if level == sound:
            deep = durable(wide.select("cid", "doc", "name", "n", "sk").dropDuplicates(["cid"]))
        level += 1
        at = F.pmod(F.xxhash64("node", F.lit("coordinate")), F.lit(COORDINATES))
        rows = wide.select("tree", "node", "cid", "doc", "name", "n", "sk").join(classes.select("cid", "sig"), "cid").select("tree", F.xxhash64("node", token(at)).alias("node"), "cid", "doc", "name", "n", "sk")
    return reduce(DataFrame.unionAll, done), level, deep


def _more_leaves(docs: DataFrame, deep: DataFrame, k: int, trees: int, small: int, depth: int, sound: int, missed: float, s: float) -> Iterator[DataFrame]:
    """Leaves of further groups of trees over the classes of deep nodes, until pairs in them are found too."""
    ids = durable(deep.select(F.col("doc").alias("doc_id")))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(with_small(ids, ids.count(), 16), "doc_id", "left_semi")
    group, level = 1, depth
    while missed > MISSED:
        groups = max(1, math.ceil(math.log(MISSED / missed) / math.log(_missed(level, trees, s))))
        sigs = profiles(chosen, k, group, groups).where("n_shingles > 0").select("cid", "sig").dropDuplicates(["cid"])
        leaves, level, _ = _leaves(durable(deep.join(sigs, "cid")), trees, group * trees, (group + groups) * trees - 1, small, depth, sound, group)
        yield leaves
        missed *= _missed(level, trees, s) ** groups
        group += groups


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole cells of a stream sorted by ``cell``, many at a time, with the cells' numbers."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        cell = t.column("cell").to_numpy()
        last = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
        held = t.slice(last)
        if last:
            yield t.slice(0, last).combine_chunks(), cell[:last]
    if held is not None and held.num_rows:
        yield held.combine_chunks(), held.column("cell").to_numpy()


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bytes of the rows of 64-bit words differ."""
    d = x ^ y
    d |= d >> np.uint64(4)
    d |= d >> np.uint64(2)
    d |= d >> np.uint64(1)
    return np.bitwise_count(d & _ONES).sum(axis=1, dtype=np.int32)


def _in_reach(rows: DataFrame, percent: int) -> DataFrame:
    """(cell, cid, name) of the members of cells (cell, cid, name, n, sk, side) with a partner in reach that has another name.

    Members of side 0 meet all, those of sides 1 and 2 only the other side.
    """
    s = percent / 100
    words = COORDINATES // 8
    quick, full = 16 - _bar(s, 16), COORDINATES - _bar(s, COORDINATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cell in _cells(batches):
            n, name, side = (t.column(c).to_numpy() for c in ("n", "name", "side"))
            sk = np.frombuffer(b"".join(t.column("sk").to_pylist()), np.uint64).reshape(-1, words)
            flag = np.zeros(len(cell), bool)
            i, off = np.arange(len(cell)), 1
            while True:
                i = i[i + off < len(cell)]
                i = i[cell[i] == cell[i + off]]
                if not len(i):
                    break
                for a in range(0, len(i), 1 << 16):
                    p = i[a : a + (1 << 16)]
                    q = p + off
                    ok = (100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q])) & (name[p] != name[q]) & ((side[p] != side[q]) | (side[p] == 0))
                    p, q = p[ok], q[ok]
                    ok = _differ(sk[p, :2], sk[q, :2]) <= quick
                    p, q = p[ok], q[ok]
                    ok = _differ(sk[p], sk[q]) <= full
                    flag[p[ok]] = flag[q[ok]] = True
                off += 1
            if flag.any():
                yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks().filter(pa.array(flag)) for c in ("cell", "cid", "name", "side")], ["cell", "cid", "name", "side"])

    dealt = rows.select("cell", "cid", "name", "n", "sk", "side").repartition("cell").sortWithinPartitions("cell")
    return arrow(dealt, run, "cell long, cid binary, name long, side int")


def _blobs(docs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(cid, blob): the full sets of the classes (cid, doc) in ``rows``, 48 bits of each shingle, in order."""
    used = durable(rows.select(F.col("doc").alias("doc_id")).distinct())
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(with_small(used, used.count(), 16), "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, blob = [], []
            for _, u in _sets(batch, k):
                if len(u):
                    cid.append(_class_id(u))
                    blob.append((u >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.binary()), pa.array(blob, pa.binary())], ["cid", "blob"])

    return arrow(chosen, sets, "cid binary, blob binary").dropDuplicates(["cid"])


def _grown(blobs: list[bytes], name: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the members of one cell to components, as pairs of names; only those that join two."""
    size = np.array([len(x) // 6 for x in blobs])
    raw = np.zeros((int(size.sum()), 8), np.uint8)
    raw[:, :6] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    token = np.unique(raw.view(np.uint64).ravel(), return_inverse=True)[1]
    start = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(token.max()) + 1, np.int8)
    label = np.unique(name, return_inverse=True)[1]
    out = []
    for i in range(len(size) - 1):
        ok = (label[i + 1 :] != label[i]) & (100 * np.minimum(size[i], size[i + 1 :]) >= percent * np.maximum(size[i], size[i + 1 :])) & ((side[i + 1 :] != side[i]) | (side[i] == 0))
        if not ok.any():
            continue
        mark[token[start[i] : start[i + 1]]] = 1
        common = np.add.reduceat(mark[token[start[i + 1] :]], start[i + 1 : -1] - start[i + 1], dtype=np.int64)
        mark[token[start[i] : start[i + 1]]] = 0
        for j in np.flatnonzero(ok & (100 * common >= percent * (size[i] + size[i + 1 :] - common))) + i + 1:
            if label[j] != label[i]:
                out.append((int(name[i]), int(name[j])))
                label[label == label[j]] = label[i]
    return out


def _links(docs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): names joined by a link between members of a cell (cell, cid, doc, name, n, sk, side)."""
    reach = durable(_in_reach(rows, percent))
    # sets are read from the document that a class is named by
    doc = rows.select("cid", "doc").join(with_small(ids := durable(reach.select("cid").distinct()), ids.count(), 32), "cid", "left_semi").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cell in _cells(batches):
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            name, side, blob = t.column("name").to_numpy(), t.column("side").to_numpy(), t.column("blob")
            found = [x for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1 for x in _grown(blob.slice(a, b - a).to_pylist(), name[a:b], side[a:b], percent)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    dealt = reach.join(_blobs(docs, doc, k), "cid").select("cell", "name", "side", "blob").repartition("cell").sortWithinPartitions("cell")
    return durable(arrow(dealt, run, "a long, b long").distinct())


def _blocks(wide: DataFrame) -> DataFrame:
    """Cells of nodes that are still large: each member outside the node's largest component meets all members, block by block."""
    parts = wide.groupBy("node", "name").agg(F.count("*").alias("m")).groupBy("node").agg(F.count("*").alias("parts"), F.max_by("name", F.struct("m", "name")).alias("main")).where("parts > 1")
    rows = durable(wide.join(parts.select("node", "main"), "node").withColumn("far", F.col("name") != F.col("main")))
    counts = rows.groupBy("node", "far").agg(F.ceil(_weight() / BLOCK).cast("int").alias("m")).groupBy("node").agg(F.max(F.when(F.col("far"), F.col("m"))).alias("fars"), F.max(F.when(~F.col("far"), F.col("m"))).alias("mains"))
    rows = rows.join(counts, "node").withColumn("own", F.pmod(F.xxhash64("cid"), F.when(F.col("far"), F.col("fars")).otherwise(F.col("mains"))).cast("int"))
    # a far block meets itself (side 0), each other far block and each block of the main component (1 against 2)
    cell = lambda kind, x, y: F.xxhash64("node", F.lit(kind), x, y)
    place = lambda kind, x, y, side: F.struct(cell(kind, x, y).alias("cell"), F.lit(side).alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    far = F.transform(upto("fars"), lambda o: F.when(o == F.col("own"), place("far", o, o, 0)).when(F.col("own") < o, place("far", F.col("own"), o, 1)).otherwise(place("far", o, F.col("own"), 2)))
    near = F.transform(upto("mains"), lambda o: place("main", F.col("own"), o, 1))
    main = F.transform(upto("fars"), lambda o: place("main", o, F.col("own"), 2))
    return rows.select(F.inline(F.when(F.col("far"), F.concat(far, near)).otherwise(main)), "cid", "doc", "name", "n", "sk")


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, trees: int = 8, small: int = 2048, depth: int = 8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs`` (doc_id, text, any others).

    Documents are linked where 100 * |intersection| >= ``percent`` * |union| of their sets of
    distinct ``k``-word shingles (lower-cased A-Z); a text of fewer words has all of them as its one
    shingle. Null, empty and blank texts have an empty set and link with nothing. Rows that repeat a
    doc_id are one document, linked through any of its texts. A null doc_id links with nothing, has
    component_id null and is kept. An empty table gives no rows.
    """
    prof = durable(profiles(docs, k))
    whole = prof.where("n_shingles > 0 and doc_id is not null")
    classes = durable(whole.groupBy("cid").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("sk").alias("sk")))
    s, most = percent / 100, max(small, BLOCK)
    sound = max([d for d in range(1, depth + 1) if _missed(d, trees, s) <= MISSED], default=1)
    cells = lambda rows: rows.where(F.col("size") <= most).select(F.col("node").alias("cell"), "cid", "doc", "name", "n", "sk", F.lit(0).alias("side"))

    # the first trees, where large nodes have leaders
    leaves, _, _ = _leaves(classes.withColumn("name", F.col("doc")), trees, 0, AHEAD - 1, small, depth, sound)
    edges = _links(docs, cells(leaves), k, percent)
    oversize = leaves.where(F.col("size") > most)
    if oversize.take(1):
        lead = oversize.groupBy("node").agg(F.min(F.struct("cid", "doc", "n", "sk")).alias("lead"))
        star = oversize.join(lead, "node").where(f"cid <> lead.cid and 100 * least(n, lead.n) >= {percent} * greatest(n, lead.n)")
        star = star.select(F.xxhash64("cid", "lead.cid").alias("cell"), F.array(F.struct("cid", "doc", "n", "sk"), "lead").alias("two")).dropDuplicates(["cell"])
        edges = edges.unionAll(_links(docs, star.select("cell", F.inline("two")).withColumns({"name": F.col("doc"), "side": F.lit(0)}), k, percent))
    near = durable(connected_components(edges))

    # the other trees, with what is joined already, and the blocks of nodes that stay large
    rest, level, deep = _leaves(durable(_named(classes.withColumn("name", F.col("doc")), near, "name")), trees, AHEAD, trees - 1, small, depth, sound)
    rest = rest.unionAll(_named(oversize, near, "name").select(*LEAF))
    if deep is not None:
        rest = reduce(DataFrame.unionAll, _more_leaves(docs, deep, k, trees, small, depth, sound, _missed(level, trees, s), s), rest)
    later = cells(rest)
    oversize = rest.where(F.col("size") > most)
    if oversize.take(1):
        later = later.unionByName(_blocks(oversize))
    rest = _links(docs, later, k, percent)
    # an id with several texts holds their classes together
    several = whole.groupBy("doc_id").agg(F.min("cid").alias("x"), F.max("cid").alias("y")).where("x <> y").select("doc_id")
    several = whole.join(several, "doc_id", "left_semi").join(classes.select("cid", "doc"), "cid").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    far = connected_components(_named(_named(rest.unionAll(several), near, "a"), near, "b"))
    own = prof.select("doc_id", "n_shingles", "cid").join(classes.select("cid", "doc"), "cid", "left").withColumn("component", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("doc")), "doc_id"))
    own = _named(_named(own, near, "component"), far, "component")
    return own.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))


def _named(df: DataFrame, components: DataFrame, column: str) -> DataFrame:
    """``column`` replaced by its component where it has one."""
    found = components.select(F.col("id").alias("__id"), F.col("component").alias("__component"))
    return df.join(found, F.col(column) == F.col("__id"), "left").withColumn(column, F.coalesce("__component", column)).drop("__id", "__component")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
