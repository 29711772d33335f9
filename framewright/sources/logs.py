"""Line logs, prompt documents and path lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("label", T.IntegerType())])
PROMPTS = T.StructType([T.StructField("format", T.IntegerType()), T.StructField("frames", T.ArrayType(T.StructType([T.StructField("frame", T.IntegerType()), T.StructField("targets", T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("points", T.ArrayType(POINT)), T.StructField("box", T.ArrayType(T.DoubleType()))])))])))])


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines log; lines that are cut off or no objects are skipped."""
    fields = f"{schema}, _bad string"
    rec = F.from_json("value", fields, {"columnNameOfCorruptRecord": "_bad"}).alias("r")
    lines = spark.read.text(path).where(F.trim("value").startswith("{"))
    return lines.select(rec).where("r is not null and r._bad is null").select("r.*").drop("_bad")


def latest(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last record of each key."""
    row = F.struct(order, *(c for c in log.columns if c != order))
    return log.groupBy(*key).agg(F.max(row).alias("last")).select("last.*")


def append_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(frame, target, points, box) of a prompt document; a file that doesn't fit the schema raises."""
    doc = spark.read.schema(PROMPTS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return doc.select(F.explode("frames").alias("f")).select("f.frame", F.explode("f.targets").alias("t")).select("frame", F.col("t.id").alias("target"), "t.points", "t.box")


def prompt_problems(prompts: DataFrame, width: int, height: int) -> DataFrame:
    """(frame, target, problem): what makes a prompt unusable; no row if nothing does."""
    p = F.col("points")
    outside = F.exists(p, lambda q: (q["x"] < 0) | (q["x"] >= width) | (q["y"] < 0) | (q["y"] >= height))
    label = F.exists(p, lambda q: ~q["label"].isin(0, 1))
    empty = F.col("box").isNull() & ~F.coalesce(F.exists(p, lambda q: q["label"] == 1), F.lit(False))
    box = F.col("box").isNotNull() & ((F.size("box") != 4) | (F.get("box", F.lit(0)) >= F.get("box", F.lit(2))) | (F.get("box", F.lit(1)) >= F.get("box", F.lit(3))))
    found = F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in (("outside", outside), ("label", label), ("empty", empty), ("box", box))))
    own = prompts.select("frame", "target", F.explode(F.filter(found, lambda s: s.isNotNull())).alias("problem"))
    twice = prompts.groupBy("frame", "target").count().where("count > 1").select("frame", "target", F.lit("repeated").alias("problem"))
    return own.unionAll(twice)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(line, path, start, end) of a list of clips: quoted paths, ``--start`` and ``--end`` in seconds, ``#`` comments."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "(^|\\s)#.*$", "")).alias("line")).where("line <> ''")
    name = F.regexp_extract("line", '^(?:"([^"]*)"|(\\S+))', 1)
    bare = F.regexp_extract("line", '^(?:"([^"]*)"|(\\S+))', 2)
    number = lambda flag: F.nullif(F.regexp_extract("line", f"--{flag}\\s+([0-9.]+)", 1), F.lit("")).try_cast("double")
    return lines.select("line", F.when(name != "", name).otherwise(bare).alias("path"), number("start").alias("start"), number("end").alias("end"))
