"""Log-log price elasticity per key, as grouped OLS aggregates.

Plan shape for any key (sku, category, ...):

    partial sum(qty) by (key, price) -> Exchange(key, price) -> final sum
    -> partial regr_* by key -> Exchange(key) -> final regr_* -> filter(n >= 3)

Both aggregates combine map-side, so a key holding a third of all rows still
ships one small buffer per map task instead of its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelab.functions import ELASTICITY_EDGES, ELASTICITY_LABELS, bin_label, snap_zero


def price_demand(fact: DataFrame, key: str, positive_only: bool = False) -> DataFrame:
    """Total quantity per (key, unit price) with natural logs of both.

    ``positive_only`` keeps rows with price > 0 and quantity > 0 after grouping
    (the category variant); rows of a missing key are dropped.
    """
    pd_ = quantity_by_price(fact, key)
    if positive_only:
        pd_ = pd_.where((F.col("unit_price") > 0) & (F.col("qty") > 0))
    return with_logs(pd_)


def quantity_by_price(fact: DataFrame, key: str) -> DataFrame:
    """Σ qty per (key, unit price), missing keys dropped (map-side combined)."""
    return (fact.where(F.col(key).isNotNull() & F.col("unit_price").isNotNull())
                .groupBy(key, "unit_price").agg(F.sum("qty").alias("qty")))


def with_logs(price_demand_df: DataFrame) -> DataFrame:
    return price_demand_df.withColumns({"log_price": F.ln("unit_price"), "log_qty": F.ln("qty")})


def fit_elasticity(price_demand_df: DataFrame, key: str, min_points: int = 3,
                   r2_name: str = "r2", with_points: bool = False,
                   edges: Sequence[float] = ELASTICITY_EDGES,
                   labels: Sequence[str] = ELASTICITY_LABELS, sort: bool = False) -> DataFrame:
    """OLS slope (= elasticity) and R² of ``log_qty`` on ``log_price`` per key.

    Keys with fewer than ``min_points`` price points are skipped.  The input has
    one row per (key, price), so the row count equals the number of distinct prices.
    ``sort`` orders the result by ascending elasticity (ties by key) for reports;
    leave it off when the table feeds a join.
    """
    fitted = (price_demand_df.groupBy(key).agg(
                  F.regr_slope("log_qty", "log_price").alias("elasticity"),
                  F.regr_r2("log_qty", "log_price").alias(r2_name),
                  F.count(F.lit(1)).alias("n_price_points"))
              .where(F.col("n_price_points") >= min_points))
    out = classified(fitted, edges, labels)
    cols = [key, "elasticity", r2_name] + (["n_price_points"] if with_points else [])
    out = out.select(*cols, "elasticity_range")
    return out.orderBy("elasticity", key) if sort else out


def classified(fitted: DataFrame, edges: Sequence[float] = ELASTICITY_EDGES, labels: Sequence[str] = ELASTICITY_LABELS) -> DataFrame:
    """Fitted rows with solver noise at 0 removed and their elasticity class."""
    fitted = fitted.withColumn("elasticity", snap_zero("elasticity"))
    return fitted.withColumn("elasticity_range", bin_label("elasticity", edges, labels))


def range_counts(elasticity_df: DataFrame, labels: Sequence[str] = ELASTICITY_LABELS) -> DataFrame:
    """Keys per elasticity class, including classes with no key (count 0)."""
    spark = elasticity_df.sparkSession
    label_df = spark.createDataFrame([(lab, i) for i, lab in enumerate(labels)],
                                     "elasticity_range string, label_order int")
    counts = elasticity_df.groupBy("elasticity_range").agg(F.count(F.lit(1)).alias("count"))
    # at most one row per label: a proven broadcast bound, on the side a left join can broadcast
    return (label_df.join(F.broadcast(counts), "elasticity_range", "left")
            .select("elasticity_range", F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                    "label_order")
            .orderBy(F.desc("count"), "label_order"))  # most frequent first, like value_counts()


def range_share(elasticity_df: DataFrame, labels: Sequence[str] = ELASTICITY_LABELS) -> DataFrame:
    """Class counts with their share of all fitted keys."""
    counts = range_counts(elasticity_df, labels)
    # one row per label: a window over the whole (len(labels)-row) table is bounded
    total = F.sum("count").over(Window.partitionBy())
    return counts.select("elasticity_range", "count",
                         F.try_divide(F.col("count").cast("double"), total.cast("double")).alias("share"),
                         "label_order")


def peak_price(price_demand_df: DataFrame, key: str) -> DataFrame:
    """Unit price with the largest total quantity per key (ties: the lowest price).

    One buffer per key is merged map-side, so the (key, price) rows are not dealt by key."""
    peak = price_demand_df.groupBy(key).agg(F.max(F.struct("qty", (-F.col("unit_price")).alias("less"))).alias("p"))
    return peak.select(key, (-F.col("p.less")).alias("peak_price"), F.col("p.qty").alias("peak_qty"))
