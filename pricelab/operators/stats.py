"""Exact grouped median without gathering a group into one task.

Spark's ``median`` merges all distinct values of a group in one task, which does not hold when one
group carries a third of the rows.  Here one lazy plan takes two passes: the first gives each group its count, mean and a
narrow range around the middle from a bounded sketch; the second counts the values below the range
as one and the distinct values inside it one by one, and looks up the middle rank (two for an even count) among
these.  The sketch only decides how narrow the range is; the ranks come from exact counts, and a middle rank outside the
range raises.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The range holds about two of so many parts of a group; accuracy of the sketch that proposes it (its error
#: is one part in that many, a twentieth of the range's margin).
CUTS = 1000
ACCURACY = 20_000


def grouped_stats(df: DataFrame, group_cols: Sequence[str], value_col: str, cuts: int = CUTS) -> DataFrame:
    """Per group: n, mean and exact median of ``value_col`` (mean of the two middle values for even n).

    NULL and NaN values are ignored; groups with no value are absent; a NULL group is a group.
    """
    g = list(group_cols)
    # dealt once for both passes, in parts that Spark can split; the key is derived above, so that both read the same columns, and never null, so that
    # the join adds no filter to one of them
    vals = df.where(F.col(value_col).isNotNull() & ~F.isnan(value_col)).select(*g, F.col(value_col).cast("double").alias("_v")).hint("rebalance", *g, "_v")
    vals = vals.select(F.coalesce(F.to_json(F.struct(*g), {"ignoreNullFields": "false"}), F.lit("")).alias("_g"), *g, "_v")
    margin = min(0.5, 1 / cuts)
    groups = vals.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("_mean"), F.percentile_approx("_v", [0.5 - margin, 0.5 + margin], ACCURACY).alias("_range"))
    groups = groups.select("_g", "_n", "_mean", F.col("_range")[0].alias("_lo"), F.col("_range")[1].alias("_hi"))
    # all values below the range share the key NULL, which the window puts first
    placed = vals.join(groups, "_g").where(F.col("_v") <= F.col("_hi")).select("_g", *g, "_n", "_mean", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v"))
    counts = placed.groupBy("_g", *g, "_n", "_mean", "_v").agg(F.count(F.lit(1)).alias("_m"))
    counts = counts.withColumn("_upto", F.sum("_m").over(Window.partitionBy("_g").orderBy(F.col("_v").asc_nulls_first())))
    middle = F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2))
    hit = F.exists(middle, lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_m")))
    found = counts.groupBy("_g", *g, "_n", "_mean").agg(F.min(F.when(hit, F.col("_v"))).alias("_a"), F.max(F.when(hit, F.col("_v"))).alias("_b"), F.max("_upto").alias("_seen"),
                                                        F.coalesce(F.max(F.when(F.col("_v").isNull(), F.col("_m"))), F.lit(0)).alias("_below"))
    inside = (F.col("_below") <= F.floor((F.col("_n") - 1) / 2)) & (F.col("_seen") > F.floor(F.col("_n") / 2))
    median = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((F.col("_a") + F.col("_b")) / F.lit(2.0))
    median = F.when(inside, median).otherwise(F.raise_error(F.lit("the sketch missed the middle of a group")).cast("double"))
    return found.select(*g, F.col("_n").alias("n"), F.col("_mean").alias("mean"), median.alias("median"))


def grouped_median(df: DataFrame, group_cols: Sequence[str], value_col: str, out_col: str = "median", cuts: int = CUTS) -> DataFrame:
    """Exact median per group (see :func:`grouped_stats`)."""
    return grouped_stats(df, group_cols, value_col, cuts).select(*group_cols, F.col("median").alias(out_col))
