"""Repeated line runs, found by a suffix array over line ids and deleted but for their first copy.

Distributed prefix doubling: the rank of a position at level k says where the suffixes that share
its next 2^k lines begin in the suffix array. Level 0 ranks the lines; level k+1 ranks the pairs
(rank at i, rank at i + 2^k), within each pair's first component only. Positions whose prefix occurs
once are settled and drop out, so that the work shrinks with the repeats that are left. Two ranks
that overlap name any prefix length in between: the suffixes with equal names are one interval of
common prefix at least that long.

A run of lines is repeated text if it has ``words`` words. A line lies in a later copy of such a run
just if it lies in a later copy of a shortest one, which starts or ends at a given line and can't be
made shorter at its other end. Those have at most ``words`` lines (blank lines are no part of the
sequence), so log2(words) levels are enough, and the union of the deleted copies is that of the
maximal runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import durable, table, with_small

_NULL_ID = -(1 << 63)
_SLICES = 4096
_SPACE = "[ \\t\\x0B\\f\\r]+"


def _keys(docs: DataFrame) -> tuple[Column, Column]:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(_NULL_ID)), F.xxhash64(docs["text"])


def _starts(groups: DataFrame, within: list[str], slice_of: Column, order: list[str]) -> Column | DataFrame:
    """Adds ``before``: how many positions the groups before this one have, in ``order``, for equal ``within``.

    Two steps, so that no window holds more than a slice: sums of slices first, then inside a slice.
    """
    groups = groups.withColumn("slice", slice_of)
    sums = groups.groupBy(*within, "slice").agg(F.sum("n").alias("slice_n"))
    ahead = Window.partitionBy(*within).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("slices_before", F.coalesce(F.sum("slice_n").over(ahead), F.lit(0))).drop("slice_n")
    inside = Window.partitionBy(*within, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return groups.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, [*within, "slice"]).withColumn("before", F.col("inside") + F.col("slices_before")).drop("slice", "inside", "slices_before")


def repeated_lines(docs: DataFrame, words: int = 50) -> DataFrame:
    """(did, h, gone): for each document with lines to delete their 0-based numbers.

    Documents are ordered by id, then by text hash; did is the id or, for null, the smallest long,
    and h the hash of the text. Rows that repeat both are one document.
    """
    did, h = _keys(docs)
    line = docs.select(did.alias("did"), h.alias("h"), F.split("text", "\n").alias("all")).where("all is not null")
    line = line.withColumn("kept", F.filter(F.transform("all", lambda x, i: F.struct(x.alias("x"), i.alias("pos"))), lambda s: F.trim(F.translate(s["x"], "\t\x0b\f\r", "    ")) != ""))
    line = line.select("did", "h", F.posexplode("kept").alias("idx", "s")).select("did", "h", "idx", "s.pos", F.xxhash64("s.x").alias("h1"), F.xxhash64("s.x", F.lit(1)).alias("h2"), F.size(F.split(F.trim(F.regexp_replace("s.x", _SPACE, " ")), " ")).alias("w"))
    line = durable(line.dropDuplicates(["did", "h", "idx"]))

    # level 0: equal lines, in the order of their hashes
    same = line.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").withColumn("whole", F.lit(0))
    same = _starts(same, ["whole"], F.shiftright("h1", 52), ["h1", "h2"])
    level = durable(line.join(same.select("h1", "h2", F.col("before").alias("rank")), ["h1", "h2"]).select("did", "h", "idx", "pos", "w", "rank"))
    total = level.count()
    first, levels, k = level, [level.select("did", "h", "idx", "rank", F.lit(0).alias("k"))], 0
    width = max(1, -(-total // _SLICES))
    while total and 2 << k <= words:
        ahead = Window.partitionBy("did", "h").orderBy("idx").rangeBetween(1 << k, 1 << k)
        pairs = level.select("did", "h", "idx", F.col("rank").alias("r1"), F.first("rank").over(ahead).alias("r2")).where("r2 is not null")
        pairs = durable(pairs)
        groups = pairs.groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1")
        ranked = _starts(groups, ["r1"], F.floor(F.col("r2") / width), ["r2"]).select("r1", "r2", (F.col("r1") + F.col("before")).alias("rank"))
        level = durable(pairs.join(ranked, ["r1", "r2"]).select("did", "h", "idx", "rank"))
        k += 1
        if not level.take(1):
            break
        levels.append(level.select("did", "h", "idx", "rank", F.lit(k).alias("k")))

    # the shortest runs of enough words from, and up to, every line of an unbroken stretch of repeated lines
    doc = Window.partitionBy("did", "h").orderBy("idx")
    stretch = first.withColumn("run", F.col("idx") - F.row_number().over(doc))
    own = Window.partitionBy("did", "h", "run").orderBy("idx")
    upto = stretch.withColumn("s", F.sum("w").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")).withColumn("is_last", F.lead("idx").over(own).isNull())
    none = F.array().cast("array<struct<idx:int,s:bigint>>")
    edges = upto.select("did", "h", "run", F.explode(F.concat(F.array(F.struct("idx", "s")), F.when(F.col("is_last"), F.array(F.struct((F.col("idx") + 1).alias("idx"), (F.col("s") + F.col("w")).alias("s")))).otherwise(none))).alias("e")).select("did", "h", "run", "e.*")
    by_words = Window.partitionBy("did", "h", "run")
    ends = F.last("idx").over(by_words.orderBy(F.desc("s")).rangeBetween(Window.unboundedPreceding, -words))
    begins = F.last("idx").over(by_words.orderBy("s").rangeBetween(Window.unboundedPreceding, -words))
    runs = edges.select("did", "h", "idx", ends.alias("end"), begins.alias("begin"))
    runs = runs.select("did", "h", F.explode(F.array(F.struct(F.col("idx").alias("at"), (F.col("end") - F.col("idx")).alias("len")), F.struct(F.col("begin").alias("at"), (F.col("idx") - F.col("begin")).alias("len")))).alias("q")).select("did", "h", "q.*").where("at is not null and len is not null").distinct()
    runs = runs.withColumn("k", F.floor(F.log2("len")).cast("int")).withColumn("tail", F.col("at") + F.col("len") - F.expr("shiftleft(1, k)"))
    ranks = levels[0]
    for x in levels[1:]:
        ranks = ranks.unionAll(x)
    named = runs.join(ranks.select("did", "h", F.col("idx").alias("at"), "k", F.col("rank").alias("ra")), ["did", "h", "at", "k"]).join(ranks.select("did", "h", F.col("idx").alias("tail"), "k", F.col("rank").alias("rb")), ["did", "h", "tail", "k"])
    named = durable(named.select("did", "h", "at", "len", "ra", "rb"))
    origin = named.groupBy("len", "ra", "rb").agg(F.min(F.struct("did", "h", "at")).alias("o"), F.count("*").alias("n")).where("n > 1")
    later = named.join(origin, ["len", "ra", "rb"]).where("struct(did, h, at) <> o")
    gone = later.select("did", "h", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("len") - 1)).alias("idx")).distinct()
    return gone.join(first.select("did", "h", "idx", "pos"), ["did", "h", "idx"]).groupBy("did", "h").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, words: int = 50) -> DataFrame:
    """All columns of ``docs`` with the text cleaned, and n_lines and removed (line numbers from 0).

    In every run of equal lines that occurs more than once and has at least ``words`` words, the
    lines of all copies but the first (by doc_id, then place) go; lines in between that are blank
    stay. Null texts stay null and have no lines, an empty text has one. Null ids count as the
    first. Rows that repeat id and text are one document and are cleaned alike. Columns named
    n_lines or removed are replaced.
    """
    gone = durable(repeated_lines(docs, words))
    size = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    did, h = _keys(docs)
    marked = docs.drop("n_lines", "removed").withColumns({"__did": did, "__h": h})
    joined = marked.join(with_small(gone.select(F.col("did").alias("__did"), F.col("h").alias("__h"), F.col("gone").alias("__gone")), size[0] + size[1] // 8, 64), ["__did", "__h"], "left")
    every = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("__gone"))
    cleaned = F.when(F.col("__gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(every, i)), "\n"))
    out = joined.withColumns({"__clean": cleaned, "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(every)).cast("long"), "removed": F.coalesce(F.array_sort("__gone"), F.array().cast("array<int>"))})
    return out.withColumn("text", F.col("__clean")).select(*(c for c in docs.columns if c not in ("n_lines", "removed")), "n_lines", "removed")


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("clean_sha256"))


ORACLE = r"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, pos, ls[pos + 1] AS x FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS pos FROM raw)),
nb AS (SELECT doc_id, pos, x, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i,
              len(string_split(trim(regexp_replace(x, '[ \t\x0B\f\r]+', ' ', 'g')), ' ')) AS w
       FROM l WHERE trim(translate(x, chr(9) || chr(11) || chr(12) || chr(13), '    ')) <> ''),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM nb),
runs AS (
  SELECT a.doc_id, a.i AS i, min(b.i) AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.w >= 50 GROUP BY 1, 2
  UNION SELECT b.doc_id, max(a.i), b.i FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.w >= 50 GROUP BY 1, b.i),
named AS (SELECT r.doc_id, r.i, r.j, string_agg(c.x, chr(10) ORDER BY c.i) AS body FROM runs r JOIN c ON c.doc_id = r.doc_id AND c.i BETWEEN r.i AND r.j GROUP BY 1, 2, 3),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS r FROM named) WHERE r > 1),
gone AS (SELECT DISTINCT c.doc_id, c.pos FROM later n JOIN c ON c.doc_id = n.doc_id AND c.i BETWEEN n.i AND n.j),
del AS (SELECT doc_id, count(*) AS n, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS removed FROM gone GROUP BY 1),
kept AS (SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.pos) AS t FROM l ANTI JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY 1)
SELECT raw.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(del.n, 0)::BIGINT AS n_removed, coalesce(del.removed, '') AS removed, sha256(coalesce(kept.t, '')) AS clean_sha256
FROM raw LEFT JOIN del USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
