"""Roll-ups of the sales fact: per-key summaries, counts, curves, top-k, calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from pricelab.functions import exact_sum
from pricelab.functions.expressions import EXACT, exact_total

#: Row positions: a numeric buffer wide enough for (file, block, row).
ORDER = T.DecimalType(38, 0)


def key_rollup(fact: DataFrame, key: str = "sku", order: Column | str = "_row_order", exact: bool = False) -> DataFrame:
    """Per key: mean unit price, total qty, total revenue, first style and category."""
    return key_summary(fact, key, order, exact).drop("count")


def key_summary(fact: DataFrame, key: str = "sku", order: Column | str = "_row_order", exact: bool = False) -> DataFrame:
    """:func:`key_rollup` with the number of rows.

    ``order`` is a number that defines "first" (default: the CSV reader's ``_row_order``, i.e. file
    order); rows without such a column have no first and are refused.  ``exact`` makes the mean independent of
    the order of summation (:func:`exact_mean`).

    The fact is reduced by (key, style, category) with numeric buffers only, so it is hash-aggregated;
    the "first" values are picked from those few rows per key.
    """
    if isinstance(order, str):
        if order not in fact.columns:
            raise ValueError(f"no column {order!r}: say by which number rows are ordered")
        order = F.col(order)
    price = F.col("unit_price").cast(EXACT) if exact else F.col("unit_price")
    few = fact.where(F.col(key).isNotNull()).groupBy(key, "style", "category").agg(
        F.sum(price).alias("price"), F.count("unit_price").alias("n"), F.count(F.lit(1)).alias("rows"), F.sum("qty").alias("qty"),
        exact_total("revenue").alias("revenue"), F.min(order.cast(ORDER)).alias("at"))

    def first(value: str) -> Column:
        return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.col("at"))).alias(value)

    return few.groupBy(key).agg(
        F.try_divide(F.sum("price").cast("double"), F.sum("n").cast("double")).alias("avg_price"), F.sum("qty").alias("total_qty"),
        exact_sum("revenue").alias("total_revenue"), first("style"), first("category"), F.sum("rows").alias("count"))


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per non-missing key value, most frequent first (ties by key)."""
    return (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), key))


def distinct_values(df: DataFrame, key: str) -> DataFrame:
    """Distinct values of one column; a missing value counts as one value."""
    return df.select(key).distinct()


def busiest_key(fact: DataFrame, key: str = "sku") -> DataFrame:
    """The key with the most rows (ties: smallest key) — one row."""
    return value_counts(fact, key).limit(1).select(key)


def demand_curve(fact: DataFrame, key_value: str, key: str = "sku") -> DataFrame:
    """Total quantity per unit price for one key, by ascending price."""
    rows = fact.where(F.col(key) == F.lit(key_value))
    return rows.groupBy("unit_price").agg(F.sum("qty").alias("qty")).orderBy("unit_price")


def busiest_demand_curve(fact: DataFrame, key: str = "sku") -> DataFrame:
    """Demand curve of the key with the most rows (ties: smallest key), in one pass.

    Both the pick and the curve come from one (key, price) pre-aggregate that also
    counts rows, so the fact is scanned and shuffled once (the exchange is reused).
    """
    return busiest_curve_of(fact.where(F.col(key).isNotNull())
                                .groupBy(key, "unit_price").agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("rows")), key)


def busiest_curve_of(per_price: DataFrame, key: str = "sku") -> DataFrame:
    """The same from a (key, unit_price) -> Σqty, rows table."""
    one = (per_price.groupBy(key).agg(F.sum("rows").alias("rows"))
                    .orderBy(F.desc("rows"), key).limit(1).select(key))
    return (per_price.join(F.broadcast(one), key, "left_semi")  # one row: proven bound
                     .select("unit_price", "qty").orderBy("unit_price"))


def top_by_revenue(fact: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Top-n keys by total revenue (a top-k report: the limit is the feature)."""
    return (fact.where(F.col(key).isNotNull())
                .groupBy(key).agg(exact_sum("revenue").alias("total_revenue"),
                                  F.sum("qty").alias("total_qty"))
                .orderBy(F.desc("total_revenue"), key).limit(n))


def revenue_by_month(fact: DataFrame) -> DataFrame:
    """Revenue, quantity and lines per calendar (year, month)."""
    return (fact.groupBy("year", "month")
                .agg(exact_sum("revenue").alias("total_revenue"), F.sum("qty").alias("total_qty"),
                     F.count(F.lit(1)).alias("n_lines"))
                .orderBy("year", "month"))


def revenue_by_weekday(fact: DataFrame) -> DataFrame:
    """Revenue, quantity and lines per day of week."""
    return (fact.groupBy("weekday")
                .agg(exact_sum("revenue").alias("total_revenue"), F.sum("qty").alias("total_qty"),
                     F.count(F.lit(1)).alias("n_lines")))


def calendar_parts(fact: DataFrame) -> DataFrame:
    """Distinct dates with their calendar parts."""
    return fact.select("date", "year", "month", "day", "weekday", "weekofyear").distinct()


def text_values(fact: DataFrame) -> DataFrame:
    """Rows per normalised (sales_channel, fulfilled_by) pair."""
    return fact.groupBy("sales_channel", "fulfilled_by").agg(F.count(F.lit(1)).alias("count"))
