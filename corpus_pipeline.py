"""A training corpus from raw documents, in five stages that each write what the next one reads.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame
with the columns of ``documents``, the last one the result. ``run`` applies them to the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import bpe, decontaminate, langid, line_dedup, minhash_dedup
from framewright.llm.common import crc_mod, durable, table, with_small

#: Below this posterior the best language is as good as a guess.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the learned languages; those without letters, or in none clearly, go. Null ids are judged like others."""
    model = langid.train(docs.where(crc_mod("doc_id", 4) != 2))
    return langid.keep(docs, model, LEAST_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated line runs of 50 words; documents of which nothing but blank lines is left then go."""
    out = line_dedup.dedup_lines(docs)
    emptied = (F.size("removed") > 0) & (F.trim(F.translate("text", "\n\t\x0b\f\r", "     ")) == "")
    return out.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays, that of the smallest id.

    Of rows that repeat both id and text the one with the smallest other columns stays; different
    texts of one id stay together or go together.
    """
    gone = durable(minhash_dedup.near_duplicates(docs, k=5, percent=80).where(~F.col("kept")).select("doc_id").distinct())
    left = docs.join(with_small(gone, gone.count(), 16), "doc_id", "left_anti").select(*docs.columns)
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1):
        return left
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = left.where("doc_id is not null").groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("rest"))
    return once.select("doc_id", "text", "rest.*").select(*docs.columns).unionAll(left.where("doc_id is null"))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the hash of their decoding."""
    return bpe.encode_decode(docs, ids=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("language ID", language), ("line dedup", lines), ("MinHash near-dedup", near_copies), ("benchmark decontamination", benchmarks), ("byte-level BPE", tokens)]

#: Null: token ids by rank merges, and the trained language model, are beyond SQL. tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        durable(spark.range(0))  # a local session gets its folder here; on a cluster without one this is an error
        where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    where = f"{where.rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{i}")
        docs = spark.read.parquet(f"{where}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
