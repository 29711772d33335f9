"""Benchmark decontamination by spaced-seed hashing.

A mask selects some of the next few token positions and ignores the rest, so a substituted token in
an ignored place doesn't matter. The masked token hashes of benchmark items and of documents are
joined; a hit fixes how the item lies on the document, and all its tokens are then compared there.

The four masks select four tokens of five in a row. An item of n tokens of which n // 5 are
substituted has, among n // 5 windows of five, one with a single substitution at most, which one of
the masks avoids: no overlap of four fifths in place is lost, at any length from five on. A
substitution lies in five windows, so at least n - 4 - 5/2 * n // 5 windows have one at most, and
each seed serves two windows at most: lays of long items with fewer hits than half of that are
dropped before their tokens are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import durable, table, with_small

#: Selected positions.
MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
#: What the masks are made for: this share of an item's tokens in place, and items of so many tokens.
SHARE, LEAST_WORDS = 0.8, 5
_NULL_ID = -(1 << 63)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _seeds(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, pos, hash) for all masks at all positions of the token hashes ``w`` at which they fit.

    Positions are exploded first, so that the hashes are computed in generated code; a mask's own
    number is part of its hash.
    """
    placed = rows.where(F.size("w") >= 4).select(*keep, "w", F.explode(F.sequence(F.lit(0), F.size("w") - 4)).alias("pos"))
    at = lambda o: F.get("w", F.col("pos") + o)
    hashes = [F.when(at(m[-1]).isNotNull(), F.xxhash64(F.lit(k), *map(at, m))) for k, m in enumerate(MASKS)]
    return placed.select(*keep, "pos", F.explode(F.array(*hashes)).alias("hash")).where("hash is not null")


def overlaps(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text_hash, item_id, start, n_words, n_equal): where a benchmark item lies in a document.

    Reported once for each document and item, at the place where most tokens agree (the first of
    those), if at least ``share`` (0.8 or more) of the item's tokens are found there in their places.
    Items of fewer than ``least_words`` (5 or more) tokens say too little and are ignored. Rows that
    repeat are one; a null doc_id is reported as null; null or empty texts hold nothing. The
    benchmark side is broadcast only if its measured size allows it, else both sides are shuffled by
    hash. Repeated benchmark texts are separate items.
    """
    if share < SHARE or least_words < LEAST_WORDS:
        raise ValueError(f"the masks find overlaps of {SHARE} in items of {LEAST_WORDS} tokens or more")
    items = benchmark.where("item_id is not null").select("item_id", tokens(F.col("text")).alias("item")).distinct().where(F.size("item") >= least_words)
    items = durable(items.withColumn("n", F.size("item")))
    n_items, n_bytes = items.agg(F.count("*"), F.coalesce(F.sum(F.length(F.array_join("item", " ")) + 8 * F.col("n")), F.lit(0))).first()
    seeds = durable(_seeds(items.withColumn("w", F.transform("item", lambda x: F.xxhash64(x))), "item_id", "n").select("item_id", "n", F.col("pos").alias("at"), "hash").distinct())
    n_seeds = seeds.count()
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("did"), F.xxhash64("text").alias("text_hash"), "text")
    hashed = own.select("did", "text_hash", F.transform(tokens(F.col("text")), lambda x: F.xxhash64(x)).alias("w"))
    hits = _seeds(hashed, "did", "text_hash").join(with_small(seeds, n_seeds, 32), "hash").select("did", "text_hash", "item_id", "n", (F.col("pos") - F.col("at")).alias("start"))
    lays = hits.groupBy("did", "text_hash", "item_id", "n", "start").agg(F.count("*").alias("hits")).where(F.col("hits") >= (F.col("n") - 4 - 2.5 * F.floor(F.col("n") / 5)) / 2).drop("hits")
    lays = durable(lays)
    where_found = durable(lays.select("did", "text_hash").distinct())
    hit_docs = durable(own.join(with_small(where_found, where_found.count(), 24), ["did", "text_hash"], "left_semi").select("did", "text_hash", tokens(F.col("text")).alias("words")).distinct())
    window = F.slice("words", F.greatest(F.col("start") + 1, F.lit(1)), F.col("n") + F.least(F.col("start"), F.lit(0)))
    at = hit_docs.join(lays, ["did", "text_hash"]).select("did", "text_hash", "item_id", "start", window.alias("window"))
    found = at.join(with_small(items, n_bytes + 16 * n_items, 1), "item_id")
    rest = F.slice("item", F.greatest(-F.col("start"), F.lit(0)) + 1, F.size("item"))
    equal = F.size(F.filter(F.zip_with(rest, "window", lambda a, b: a == b), lambda x: x))
    found = found.select("did", "text_hash", "item_id", "start", F.col("n").alias("n_words"), equal.alias("n_equal")).where(F.col("n_equal") >= share * F.col("n_words"))
    best = found.groupBy("did", "text_hash", "item_id").agg(F.max(F.struct("n_equal", (-F.col("start")).alias("back"), "n_words")).alias("b"))
    return best.select(
        F.when(F.col("did") != _NULL_ID, F.col("did")).alias("doc_id"), "text_hash", "item_id", (-F.col("b.back")).cast("long").alias("start"), F.col("b.n_words").cast("long").alias("n_words"), F.col("b.n_equal").cast("long").alias("n_equal")
    )


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item lies."""
    hits = durable(overlaps(docs, benchmark, **how).select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct())
    return docs.join(with_small(hits, hits.count(), 24), (F.coalesce(docs["doc_id"].cast("long"), F.lit(_NULL_ID)) == F.col("hit_id")) & (F.xxhash64(docs["text"]) == F.col("hit_hash")), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "start", "n_words", "n_equal")


#: All placements, without seeds: equal tokens of a document and an item are counted by the place where the item would begin.
ORACLE = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
dp AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM dw), bp AS (SELECT item_id, len(w) AS n, unnest(w) AS x, unnest(range(len(w))) AS j FROM bw WHERE len(w) >= 5),
lays AS (SELECT doc_id, item_id, n, i - j AS start, count(*) AS n_equal FROM dp JOIN bp USING (x) GROUP BY ALL HAVING count(*) >= 0.8 * n),
ok AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, start) AS r FROM lays)
SELECT doc_id, item_id, start::BIGINT AS start, n::BIGINT AS n_words, n_equal::BIGINT AS n_equal FROM ok WHERE r = 1
"""
