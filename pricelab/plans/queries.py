"""Named queries over a table directory: ``name -> (spark, base_dir) -> DataFrame``.

Each query reads the test tables, maps them onto the raw sales shape and runs
the operators.  Outputs meant for engine-to-engine comparison round floating
results where summation order can change the last bits: money sums are exact
(``functions.exact_sum``) and shown to 2 decimals, elasticity / R² / statistics
to 6, and price means use the order-independent exact form (``exact_mean``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelab import streaming
from pricelab.operators import clean, distribution, elasticity, rollup, scenarios, segments
from pricelab.plans.session import scratch_path
from pricelab.sources.csv import read_sales_csv, write_sales_csv
from pricelab.sources.fixtures import raw_sales_from_tables

Query = Callable[[SparkSession, str], DataFrame]

TOP_N = 10
#: Longest time (seconds) that the streaming query may take to consume what has arrived.
STREAM_LIMIT_S = 3600


def _r(col: str, n: int) -> F.Column:
    return F.round(F.col(col), n).alias(col)


def raw_sales(spark: SparkSession, base: str) -> DataFrame:
    return raw_sales_from_tables(spark, base)


def fact(spark: SparkSession, base: str) -> DataFrame:
    return clean.sales_fact(raw_sales(spark, base))


def _row_order() -> F.Column:
    # "first" in file order: the export lists rows by order id, then line.
    return F.col("order_id") * 1000 + F.col("line_no")


# --- flow A: cleaning -------------------------------------------------------

CLEAN_COLUMNS = ("order_id", "line_no", "date", "status", "sales_channel", "style", "sku", "category",
                 "qty", "amount", "b2b", "fulfilled_by", "unit_price", "revenue",
                 "year", "month", "day", "weekday", "weekofyear")


def q_clean_sales(spark, base):
    return fact(spark, base).select(*CLEAN_COLUMNS)


def q_csv_clean_sales(spark, base):
    """The same fact, read through the CSV source: the raw rows are exported as CSV
    (raw header spelling, text dates) into the shared checkpoint folder and scanned back."""
    raw = raw_sales(spark, base)
    path = scratch_path(spark, f"raw_sales_csv/{uuid.uuid4().hex}")
    write_sales_csv(raw, path)
    header_types = {"Order ID": T.LongType(), "Line No": T.IntegerType()}
    schema = T.StructType([T.StructField(c, header_types.get(c, T.StringType()), True) for c in raw.columns])
    f = clean.sales_fact(read_sales_csv(spark, path, schema=schema))
    return f.select(*CLEAN_COLUMNS)


def q_csv_many_files(spark, base):
    """The fact from three exports of different size, column order and spelling: missing-value words, unparsable
    numbers, and dates written in five ways."""
    raw = raw_sales(spark, base)
    root = scratch_path(spark, f"raw_sales_exports/{uuid.uuid4().hex}")
    key = F.col("Order ID")
    date = F.coalesce(*(F.when(key % 5 == i, F.date_format("Date", fmt)) for i, fmt in enumerate(("MM-dd-yy", "yyyy-MM-dd'T'HH:mm:ss", "M/d/yyyy", "M-d-yy", "MM-dd-yyyy HH:mm"))))
    text = raw.withColumns({
        "Date": date,
        "Qty": F.when(key % 97 == 19, F.lit("abc")).otherwise(F.col("Qty").cast("string")),
        "Amount": F.when(key % 97 == 23, F.lit("1D")).otherwise(F.coalesce(F.col("Amount").cast("string"), F.lit("N/A"))),
        "fulfilled-by": F.coalesce("fulfilled-by", F.lit("NA"))})
    columns = text.columns
    for i, (rows, order) in enumerate(((key % 10 < 7, columns), ((key % 10 >= 7) & (key % 10 < 9), columns[::-1]), (key % 10 == 9, columns[3:] + columns[:3]))):
        write_sales_csv(text.where(rows).select(*[F.col(f"`{c}`") for c in order]), f"{root}/export{i}")
    f = clean.sales_fact(read_sales_csv(spark, f"{root}/*"))
    return f.select(*[F.col(c).cast("long") if c == "order_id" else F.col(c).cast("int").alias(c) if c == "line_no" else F.col(c) for c in CLEAN_COLUMNS])


def q_dropped_rows(spark, base):
    return clean.dropped_rows(raw_sales(spark, base))


def q_completed_sales(spark, base):
    df = clean.completed_sales(clean.normalize_columns(clean.drop_raw_columns(raw_sales(spark, base))))
    return df.select("order_id", "line_no", "status", "sku", "qty", "amount")


def q_distinct_skus(spark, base):
    df = clean.completed_sales(clean.normalize_columns(clean.drop_raw_columns(raw_sales(spark, base))))
    return rollup.distinct_values(df, "sku")


def q_calendar_parts(spark, base):
    return rollup.calendar_parts(fact(spark, base))


def q_normalized_text(spark, base):
    return rollup.text_values(fact(spark, base))


# --- roll-ups ---------------------------------------------------------------

def q_sku_rollup(spark, base):
    r = rollup.key_rollup(fact(spark, base), "sku", order=_row_order(), exact=True)
    return r.select("sku", "avg_price", "total_qty", _r("total_revenue", 2), "style", "category")


def q_sku_counts(spark, base):
    return rollup.value_counts(fact(spark, base), "sku")


def q_category_counts(spark, base):
    return rollup.value_counts(fact(spark, base), "category")


def q_sku_demand_curve(spark, base):
    return rollup.busiest_demand_curve(fact(spark, base), "sku")


def q_sku_demand_curve_for(spark, base):
    """The curve of a key given by value; the caller takes the last key by name among those with the most rows."""
    f = fact(spark, base)
    row = rollup.value_counts(f, "sku").orderBy(F.desc("count"), F.desc("sku")).first()
    return rollup.demand_curve(f, row["sku"] if row else "", "sku")


# --- flow B: elasticity -----------------------------------------------------

def _sku_elasticity(spark, base):
    return elasticity.fit_elasticity(elasticity.price_demand(fact(spark, base), "sku"), "sku")


def _category_elasticity(spark, base):
    pdm = elasticity.price_demand(fact(spark, base), "category", positive_only=True)
    return elasticity.fit_elasticity(pdm, "category", r2_name="r_squared", with_points=True)


def q_sku_price_demand(spark, base):
    return elasticity.price_demand(fact(spark, base), "sku").select(
        "sku", "unit_price", "qty", _r("log_price", 9), _r("log_qty", 9))


def q_category_price_demand(spark, base):
    return elasticity.price_demand(fact(spark, base), "category", positive_only=True).select(
        "category", "unit_price", "qty", _r("log_price", 9), _r("log_qty", 9))


def q_sku_elasticity(spark, base):
    el = elasticity.fit_elasticity(elasticity.price_demand(fact(spark, base), "sku"), "sku", sort=True)
    return el.select("sku", _r("elasticity", 6), _r("r2", 6), "elasticity_range")


def q_category_elasticity(spark, base):
    pdm = elasticity.price_demand(fact(spark, base), "category", positive_only=True)
    el = elasticity.fit_elasticity(pdm, "category", r2_name="r_squared", with_points=True, sort=True)
    return el.select(
        "category", _r("elasticity", 6), _r("r_squared", 6), "n_price_points", "elasticity_range")


def q_sku_range_counts(spark, base):
    return elasticity.range_counts(_sku_elasticity(spark, base)).select("elasticity_range", "count")


def q_category_range_counts(spark, base):
    return elasticity.range_counts(_category_elasticity(spark, base)).select("elasticity_range", "count")


def q_sku_range_share(spark, base):
    return elasticity.range_share(_sku_elasticity(spark, base)).select(
        "elasticity_range", "count", _r("share", 9))


def q_stream_sku_price_demand(spark, base):
    """Σ qty per (sku, price) kept by the Structured Streaming query: the raw rows arrive
    as files in the shared checkpoint folder and are consumed in two or three micro-batches."""
    raw = raw_sales(spark, base)
    root = scratch_path(spark, f"stream_price_demand/{uuid.uuid4().hex}")
    raw.write.parquet(f"{root}/arrivals")
    stream = streaming.read_raw_stream(spark, f"{root}/arrivals", raw.schema, max_files_per_trigger=max(1, len(spark.read.parquet(f"{root}/arrivals").inputFiles()) // 2))
    q = streaming.run_price_demand(stream, f"{root}/table", "sku", checkpoint_location=f"{root}/state")
    if not q.awaitTermination(STREAM_LIMIT_S):
        q.stop()
        raise TimeoutError("the stream did not end in time")
    return streaming.read_price_demand(spark, f"{root}/table", "sku")


def q_sku_peak_price(spark, base):
    return elasticity.peak_price(elasticity.price_demand(fact(spark, base), "sku"), "sku")


# --- flow C: baseline and scenarios -----------------------------------------

def _base_el(spark, base):
    # Baseline and elasticity share one (category, price) pre-aggregate: one scan, one shuffle.
    # price > 0 is implied by the fact's cleaning (amount > 0, qty > 0); stating it before the
    # split keeps both branches' plans identical after pushdown, so the exchange is reused.
    qbp = elasticity.quantity_by_price(fact(spark, base).where(F.col("unit_price") > 0), "category")
    pdm = elasticity.with_logs(qbp.where(F.col("qty") > 0))
    el = elasticity.fit_elasticity(pdm, "category", r2_name="r_squared", with_points=True)
    return scenarios.with_elasticity(scenarios.baseline_from_price_demand(qbp, "category"), el)


def q_baseline(spark, base):
    return scenarios.baseline(fact(spark, base)).select("category", "baseline_qty", _r("baseline_rev", 2))


def q_baseline_elasticity(spark, base):
    return _base_el(spark, base).select("category", "baseline_qty", _r("baseline_rev", 2),
                                        _r("elasticity", 6))


def q_price_scenarios(spark, base):
    return scenarios.price_scenarios(_base_el(spark, base)).select(
        "category", _r("price_change_pct", 6), _r("baseline_revenue", 2), _r("simulated_revenue", 2),
        _r("rev_delta_pct", 6), "multiplier")


def q_price_pivot(spark, base):
    return scenarios.pivot_price_grid(scenarios.price_scenarios(_base_el(spark, base)))


def _promo_peak(spark, base):
    be = _base_el(spark, base)
    return scenarios.promo_scenarios(be), scenarios.peak_scenarios(be)


def _scen_cols(df):
    return df.select("category", "scenario", _r("baseline_rev", 2), _r("sim_rev", 2),
                     _r("rev_change_pct", 6), "multiplier")


def q_promo_scenarios(spark, base):
    return _scen_cols(_promo_peak(spark, base)[0])


def q_peak_scenarios(spark, base):
    return _scen_cols(_promo_peak(spark, base)[1])


def q_evaluation(spark, base):
    return _scen_cols(scenarios.evaluation(*_promo_peak(spark, base)))


def q_evaluation_pivot(spark, base):
    ev = scenarios.evaluation(*_promo_peak(spark, base))
    return scenarios.pivot_evaluation(ev, scenarios.scenario_labels())


# --- segments ---------------------------------------------------------------

def _meta(spark, base):
    return segments.modal_attributes(fact(spark, base), "sku")


def _seg(spark, base):
    # elasticity and modal attributes from one chain of aggregates; SKUs without an attribute drop out
    return segments.elasticity_and_attributes(fact(spark, base), "sku").na.drop(subset=list(segments.SEGMENT_SOURCES))


def q_sku_meta(spark, base):
    return _meta(spark, base)


def q_sku_segments(spark, base):
    return _seg(spark, base).select("sku", _r("elasticity", 6), _r("r2", 6), "elasticity_range",
                                    "sales_channel", "fulfilled_by", "b2b_flag")


def _segment_stats_query(dim):
    def q(spark, base):
        s = segments.segment_stats_for(_seg(spark, base), dim)
        return s.select(dim, "n_skus", _r("avg_elasticity", 6), _r("med_elasticity", 6))
    q.__name__ = f"q_segment_stats_{dim}"
    return q


def q_segment_stats(spark, base):
    s = segments.segment_stats(_seg(spark, base))
    return s.select("dimension", "value", "n_skus", _r("avg_elasticity", 6), _r("med_elasticity", 6))


def q_segment_tables(spark, base):
    """The printed segment tables: two decimals, half to even."""
    s = segments.segment_stats(_seg(spark, base))
    return s.select("dimension", "value", "n_skus", *(F.bround(F.round(c, 9), 2).alias(c) for c in ("avg_elasticity", "med_elasticity")))


# --- distribution -----------------------------------------------------------

def q_price_histogram(spark, base):
    return distribution.histogram(fact(spark, base), "unit_price", 50, weight=None)


def q_demand_by_price_bin(spark, base):
    return distribution.histogram(fact(spark, base), "unit_price", 50, weight="qty")


def q_modal_price_bin(spark, base):
    return distribution.modal_bin(distribution.histogram(fact(spark, base), "unit_price", 50, weight=None))


def q_price_density(spark, base):
    d = distribution.density(fact(spark, base), "unit_price", 200, 50)
    return d.select("grid_index", _r("unit_price", 6), _r("density", 12), _r("count_density", 6))


# --- tier 2 reports ---------------------------------------------------------

def q_top_skus_by_revenue(spark, base):
    return rollup.top_by_revenue(fact(spark, base), "sku", TOP_N).select(
        "sku", _r("total_revenue", 2), "total_qty")


def q_top_categories_by_revenue(spark, base):
    return rollup.top_by_revenue(fact(spark, base), "category", TOP_N).select(
        "category", _r("total_revenue", 2), "total_qty")


def q_revenue_by_month(spark, base):
    return rollup.revenue_by_month(fact(spark, base)).select(
        "year", "month", _r("total_revenue", 2), "total_qty", "n_lines")


def q_revenue_by_weekday(spark, base):
    return rollup.revenue_by_weekday(fact(spark, base)).select(
        "weekday", _r("total_revenue", 2), "total_qty", "n_lines")


QUERIES: dict[str, Query] = {
    "clean_sales": q_clean_sales,
    "csv_clean_sales": q_csv_clean_sales,
    "csv_many_files": q_csv_many_files,
    "dropped_rows": q_dropped_rows,
    "completed_sales": q_completed_sales,
    "distinct_skus": q_distinct_skus,
    "calendar_parts": q_calendar_parts,
    "normalized_text": q_normalized_text,
    "sku_rollup": q_sku_rollup,
    "sku_counts": q_sku_counts,
    "category_counts": q_category_counts,
    "sku_demand_curve": q_sku_demand_curve,
    "sku_demand_curve_for": q_sku_demand_curve_for,
    "sku_price_demand": q_sku_price_demand,
    "category_price_demand": q_category_price_demand,
    "sku_elasticity": q_sku_elasticity,
    "category_elasticity": q_category_elasticity,
    "sku_range_counts": q_sku_range_counts,
    "category_range_counts": q_category_range_counts,
    "sku_range_share": q_sku_range_share,
    "sku_peak_price": q_sku_peak_price,
    "stream_sku_price_demand": q_stream_sku_price_demand,
    "baseline": q_baseline,
    "baseline_elasticity": q_baseline_elasticity,
    "price_scenarios": q_price_scenarios,
    "price_pivot": q_price_pivot,
    "promo_scenarios": q_promo_scenarios,
    "peak_scenarios": q_peak_scenarios,
    "evaluation": q_evaluation,
    "evaluation_pivot": q_evaluation_pivot,
    "sku_meta": q_sku_meta,
    "sku_segments": q_sku_segments,
    "segment_stats_channel": _segment_stats_query("sales_channel"),
    "segment_stats_fulfilment": _segment_stats_query("fulfilled_by"),
    "segment_stats_b2b": _segment_stats_query("b2b_flag"),
    "segment_stats": q_segment_stats,
    "segment_tables": q_segment_tables,
    "price_histogram": q_price_histogram,
    "demand_by_price_bin": q_demand_by_price_bin,
    "modal_price_bin": q_modal_price_bin,
    "price_density": q_price_density,
    "top_skus_by_revenue": q_top_skus_by_revenue,
    "top_categories_by_revenue": q_top_categories_by_revenue,
    "revenue_by_month": q_revenue_by_month,
    "revenue_by_weekday": q_revenue_by_weekday,
}

FLAGSHIP = "evaluation_pivot"
