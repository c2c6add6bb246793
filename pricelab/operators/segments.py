"""Per-key modal attributes and elasticity statistics by segment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelab.operators.elasticity import classified
from pricelab.operators.stats import grouped_stats

# Modal attribute name -> fact column.
SEGMENT_SOURCES = {"sales_channel": "sales_channel", "fulfilled_by": "fulfilled_by", "b2b_flag": "b2b"}


def modal_attributes(fact: DataFrame, key: str = "sku",
                     sources: Mapping[str, str] = SEGMENT_SOURCES) -> DataFrame:
    """Most frequent non-missing value of each attribute per key (ties: smallest value;
    NULL when the key has no value).  Buffers hold one counter per distinct value."""
    return (fact.where(F.col(key).isNotNull())
                .groupBy(key).agg(*[F.mode(src, True).alias(name) for name, src in sources.items()]))


def price_demand_and_attributes(fact: DataFrame, key: str = "sku",
                                sources: Mapping[str, str] = SEGMENT_SOURCES) -> tuple[DataFrame, DataFrame]:
    """Σ qty per (key, price) and the modal attributes per key, from one scan of the fact.

    The fact is reduced once to (key, price, attribute values) with map-side partial sums; both results are
    aggregates over those rows, dealt by (key, price) and by (key, attribute, value), never by the key alone while
    they are many.  The mode of an attribute is the value with the most rows, ties to the smallest
    value; NULL when the key has none (the same result as :func:`modal_attributes`).
    """
    return split_detail(key_detail(fact, key, sources), key, sources)


def key_detail(fact: DataFrame, key: str = "sku", sources: Mapping[str, str] = SEGMENT_SOURCES) -> DataFrame:
    """Σ qty and rows per (key, price, attribute values)."""
    return (fact.where(F.col(key).isNotNull()).groupBy(key, "unit_price", *sources.values())
                .agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("rows")))


def split_detail(detail: DataFrame, key: str = "sku", sources: Mapping[str, str] = SEGMENT_SOURCES) -> tuple[DataFrame, DataFrame]:
    """Σ qty per (key, price) and the modal attributes per key from a :func:`key_detail` table."""
    names, cols = list(sources), list(sources.values())
    price_demand = detail.where(F.col("unit_price").isNotNull()).groupBy(key, "unit_price").agg(F.sum("qty").alias("qty"))
    long = detail.select(key, "rows", F.explode(F.array(*[
        F.struct(F.lit(i).alias("a"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cols)
    ])).alias("e")).select(key, "rows", "e.a", "e.v")
    counts = long.groupBy(key, "a", "v").agg(F.sum("rows").alias("c"))
    picks = []
    for i, (name, col) in enumerate(zip(names, cols)):
        pick = F.min_by("v", F.when((F.col("a") == i) & F.col("v").isNotNull(), F.struct(-F.col("c"), F.col("v"))))
        picks.append(pick.cast(detail.schema[col].dataType).alias(name))
    return price_demand, counts.groupBy(key).agg(*picks)


def elasticity_and_attributes(fact: DataFrame, key: str = "sku", sources: Mapping[str, str] = SEGMENT_SOURCES, min_points: int = 3) -> DataFrame:
    """Fitted keys with class and modal attributes, as one chain of two aggregates over one scan of the fact.

    Each row becomes a price item and one item for its attributes together.  Items are summed per (key, price or values) with
    map-side partial sums and dealt by all of these; the key's regression and its counts of attribute values are
    merged map-side before anything is dealt by the key.  A key with a third of all rows, almost all at prices of
    their own, is thus spread over all tasks.  A key's buffer holds one counter per distinct combination of
    attribute values (a handful); the modes of the fitted keys are picked from it.
    Equal to the join of :func:`elasticity.fit_elasticity` and :func:`modal_attributes`.
    """
    values = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(sources.values())])
    none = F.lit(None).cast(fact.select(values.alias("v")).schema["v"].dataType)
    items = [F.struct(F.lit(0).alias("a"), F.col("unit_price").alias("p"), none.alias("v"), F.col("qty").alias("w")),
             F.struct(F.lit(1).alias("a"), F.lit(None).cast("double").alias("p"), values.alias("v"), F.lit(1.0).alias("w"))]
    sums = (fact.where(F.col(key).isNotNull()).select(key, F.explode(F.array(*items)).alias("i")).select(key, "i.*")
                .groupBy(key, "a", "p", "v").agg(F.sum("w").alias("w")))
    point = (F.col("a") == 0) & F.col("p").isNotNull()
    log_price, log_qty = F.when(point, F.ln("p")), F.when(point, F.ln("w"))
    fitted = sums.groupBy(key).agg(F.regr_slope(log_qty, log_price).alias("elasticity"), F.regr_r2(log_qty, log_price).alias("r2"),
                                   F.count_if(point).alias("n_price_points"), F.collect_list(F.when(F.col("a") == 1, F.struct("v", "w"))).alias("counts"))
    fitted = fitted.where(F.col("n_price_points") >= min_points)
    modes = [_mode_of("counts", f"v{i}").alias(name) for i, name in enumerate(sources)]
    return classified(fitted.select(key, "elasticity", "r2", "n_price_points", *modes))


def _mode_of(counts: str, field: str) -> F.Column:
    """The value of a field with the largest sum of counts (ties: smallest value) in an array of (v, w); NULL without one."""
    known = F.filter(counts, lambda x: x["v"][field].isNotNull())
    each = F.array_distinct(F.transform(known, lambda x: x["v"][field]))
    total = lambda v: F.aggregate(F.filter(known, lambda x: x["v"][field] == v), F.lit(0.0), lambda s, x: s + x["w"])
    return F.array_min(F.transform(each, lambda v: F.struct((-total(v)).alias("less"), v.alias("v"))))["v"]


def segment_table(elasticity_df: DataFrame, meta: DataFrame, key: str = "sku",
                  dims: Sequence[str] = tuple(SEGMENT_SOURCES)) -> DataFrame:
    """Elasticity rows with their key's segment attributes; keys missing any attribute drop out."""
    return elasticity_df.join(meta, key, "left").na.drop(subset=list(dims))


def _stats(seg: DataFrame, group_cols: Sequence[str], value: str) -> DataFrame:
    stats = grouped_stats(seg, group_cols, value)
    return stats.select(*group_cols, F.col("n").alias("n_skus"), F.col("mean").alias("avg_elasticity"), F.col("median").alias("med_elasticity"))


def segment_stats_for(seg: DataFrame, dim: str, value: str = "elasticity") -> DataFrame:
    """Count, mean and exact median of elasticity per value of one segment column."""
    return (_stats(seg.where(F.col(dim).isNotNull()), [dim], value)
            .select(dim, "n_skus", "avg_elasticity", "med_elasticity")
            .orderBy("avg_elasticity", dim))


def segment_stats(seg: DataFrame, dims: Sequence[str] = tuple(SEGMENT_SOURCES),
                  value: str = "elasticity") -> DataFrame:
    """All segment columns at once, as a long table (dimension, value, stats...).

    One unpivot feeds one aggregate, instead of one job per dimension.
    """
    long = seg.select(value, F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims
    ])).alias("seg")).select("seg.dimension", "seg.value", value).where(F.col("value").isNotNull())
    return (_stats(long, ["dimension", "value"], value)
            .select("dimension", "value", "n_skus", "avg_elasticity", "med_elasticity")
            .orderBy("dimension", "avg_elasticity", "value"))
