"""Exact percentiles of very many values without holding them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values up to which all are ranked; beyond it only those near an approximate percentile.
FEW = 10_000


def percentiles(values: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(by, one column for each wanted share, n): exact percentiles with linear interpolation; nulls don't count.

    A sketch with a rank error of 1 / FEW narrows each percentile down to a band four errors to
    either side. Only the distinct values of the bands are ranked, with their counts, in one task a
    group, and the rows below a band are counted. Groups without values have nulls and n = 0.
    """
    names, shares = list(wanted), list(wanted.values())
    groups = [F.col(c) for c in by]
    near = 4 / FEW
    ends = F.percentile_approx(value, [x for q in shares for x in (max(q - near, 0.0), min(q + near, 1.0))], FEW)
    head = values.groupBy(*groups).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), ends.alias("ends"))
    few = F.col("n") <= FEW
    bands = F.array(*(F.struct(F.lit(k).alias("_k"), F.lit(q).alias("_q"), F.when(few, F.col("least")).otherwise(F.get("ends", F.lit(2 * k))).alias("_lo"), F.when(few, F.col("most")).otherwise(F.get("ends", F.lit(2 * k + 1))).alias("_hi")) for k, q in enumerate(shares)))
    bands = head.select(*by, "n", F.inline(bands))
    on = [F.col(f"v.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    v = values.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")).alias("v")
    joined = v.join(bands.alias("b"), on) if on else v.crossJoin(F.broadcast(bands).alias("b"))  # a row for each share
    rows = joined.where("v._v <= b._hi").select(*(F.col(f"b.{c}") for c in by), "b._k", "b._q", "b.n", F.when(F.col("v._v") >= F.col("b._lo"), F.col("v._v")).alias("_v"))
    counts = rows.groupBy(*groups, "_k", "_q", "n", "_v").agg(F.count("*").alias("_count"))  # null: what lies below the band
    upto = Window.partitionBy(*groups, "_k").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_upto", F.sum("_count").over(upto)).withColumn("_at", (F.col("n") - 1) * F.col("_q"))
    value_at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    found = ranked.groupBy(*groups, "_k").agg(value_at(F.floor("_at")).alias("_a"), value_at(F.floor("_at") + 1).alias("_b"), F.first(F.col("_at") - F.floor("_at")).alias("_u"))
    each = found.groupBy(*groups).agg(*(F.max(F.when(F.col("_k") == k, F.col("_a") + F.coalesce((F.col("_b") - F.col("_a")) * F.col("_u"), F.lit(0.0)))).alias(x) for k, x in enumerate(names))).alias("e")
    head = head.select(*by, "n").alias("h")
    out = head.join(each, [F.col(f"h.{c}").eqNullSafe(F.col(f"e.{c}")) for c in by], "left") if by else head.crossJoin(F.broadcast(each))
    return out.select(*(F.col(f"h.{c}") for c in by), *(F.col(f"e.{x}") for x in names), "h.n")
