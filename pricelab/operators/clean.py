"""Raw sales rows -> sales fact table.

One narrow plan (scan -> filter -> project, no shuffle).  Catalyst pushes the
status, positivity and not-null predicates down to the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelab.functions import (
    COMPLETED_STATUSES,
    DROPPED_RAW_COLUMNS,
    calendar_columns,
    lenient_double,
    lenient_timestamp,
    normalize_name,
    strip_lower,
)


def drop_raw_columns(df: DataFrame, names: Sequence[str] = DROPPED_RAW_COLUMNS) -> DataFrame:
    """Drop columns by their exact raw (pre-normalisation) names; absent names are ignored.

    Matching is exact and case-sensitive, and columns are picked by position, so
    headers that differ only in case from a dropped name are kept.
    """
    drop = set(names)
    keep = [i for i, c in enumerate(df.columns) if c not in drop]
    if len(keep) == len(df.columns):
        return df
    tmp = [f"_c{i}" for i in range(len(df.columns))]
    return df.toDF(*tmp).select(*[F.col(tmp[i]).alias(df.columns[i]) for i in keep])


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename every column with :func:`normalize_name` (strip, lower, ' '/'-' -> '_')."""
    return df.toDF(*[normalize_name(c) for c in df.columns])


def completed_sales(df: DataFrame, statuses: Sequence[str] = COMPLETED_STATUSES) -> DataFrame:
    """Keep rows whose lower-cased status is a completed status (missing status is dropped)."""
    return df.where(F.lower(F.col("status")).isin(*statuses))


def _dtype(df: DataFrame, name: str) -> T.DataType | None:
    return df.schema[name].dataType if name in df.columns else None


def sales_fact(raw: DataFrame, statuses: Sequence[str] = COMPLETED_STATUSES,
               date_formats: Sequence[str] = ()) -> DataFrame:
    """Clean raw export rows into the sales fact.

    drop raw columns -> normalise headers -> completed statuses -> drop rows with a
    missing amount/qty/sku -> keep amount > 0 and qty > 0 -> drop unparsable dates ->
    add ``unit_price``, ``revenue``, calendar parts -> normalise channel texts.
    Coercions never fail: bad numbers, dates and flags become NULL.
    """
    df = _coerced(raw, statuses, date_formats)
    # a positive amount or quantity is no missing one; each parsed text is named once, as the filter moves below the parsing
    df = df.where(F.col("sku").isNotNull() & (F.col("amount") > 0) & (F.col("qty") > 0) & F.col("date").isNotNull())
    derived = {
        "unit_price": F.try_divide(F.col("amount"), F.col("qty")),
        "revenue": F.col("amount"),
        **calendar_columns("date"),
    }
    for text_col in ("sales_channel", "fulfilled_by"):
        if text_col in df.columns:
            derived[text_col] = strip_lower(text_col)
    return df.withColumns(derived)


def dropped_rows(raw: DataFrame, statuses: Sequence[str] = COMPLETED_STATUSES, date_formats: Sequence[str] = ()) -> DataFrame:
    """One row of counts of the completed rows that :func:`sales_fact` leaves out, by the first rule that does."""
    df = _coerced(raw, statuses, date_formats)
    missing = F.col("amount").isNull() | F.col("qty").isNull() | F.col("sku").isNull()
    not_positive = ~missing & ((F.col("amount") <= 0) | (F.col("qty") <= 0))
    bad_date = ~missing & ~not_positive & F.col("date").isNull()
    return df.agg(F.count(F.lit(1)).alias("completed"), F.count_if(missing).alias("missing"),
                  F.count_if(not_positive).alias("not_positive"), F.count_if(bad_date).alias("bad_date"))


def _coerced(raw: DataFrame, statuses: Sequence[str], date_formats: Sequence[str]) -> DataFrame:
    df = completed_sales(normalize_columns(drop_raw_columns(raw)), statuses)
    coerced = {
        "qty": lenient_double("qty", _dtype(df, "qty")),
        "amount": lenient_double("amount", _dtype(df, "amount")),
        "date": lenient_timestamp("date", _dtype(df, "date"), date_formats),
    }
    if "b2b" in df.columns and not isinstance(_dtype(df, "b2b"), T.BooleanType):
        coerced["b2b"] = F.col("b2b").try_cast("boolean")
    return df.withColumns(coerced)
