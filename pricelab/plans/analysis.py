"""The whole analysis as one job graph: raw sales -> every result table.

The sales fact and the SKU / category elasticity tables are written once as
parquet tables and read back by everything downstream, so the raw scan and
joins run once and lineage stays short (a lost executor re-reads a written
table instead of recomputing the raw pipeline).

    python -m pricelab.plans.analysis --csv 'exports/*.csv' --out /shared/pricing
    python -m pricelab.plans.analysis --tables /root/testdata/sf0.1 --out /shared/pricing
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelab.functions import exact_sum
from pricelab.operators import clean, distribution, elasticity, rollup, scenarios, segments


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def run_analysis(spark: SparkSession, raw: DataFrame, out_dir: str, curve_sku: str | None = None, order: Column | str = "_row_order") -> dict[str, str]:
    """Compute and write every result table under ``out_dir``; returns name -> path.

    ``order`` is the number that says which row of a SKU is its first (see :func:`rollup.key_rollup`).
    """
    paths: dict[str, str] = {}

    def save(name: str, df: DataFrame) -> DataFrame:
        paths[name] = os.path.join(out_dir, name)
        return _write(df, paths[name])

    fact = save("sales_fact", clean.sales_fact(raw))

    # four reads of the fact: by SKU, by SKU and price, by category and price, by calendar
    by_sku = save("sku_summary", rollup.key_summary(fact, "sku", order))
    detail = save("sku_detail", segments.key_detail(fact, "sku"))
    by_price = save("category_prices", fact.groupBy("category", "unit_price").agg(
        F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("rows"), exact_sum("revenue").alias("revenue")))
    calendar = save("calendar", fact.groupBy("year", "month", "weekday").agg(
        F.sum("qty").alias("total_qty"), F.count(F.lit(1)).alias("n_lines"), exact_sum("revenue").alias("total_revenue")))

    # roll-ups and distribution of unit prices
    save("sku_agg", by_sku.drop("count"))
    save("sku_counts", by_sku.select("sku", "count").orderBy(F.desc("count"), "sku"))
    save("top_skus_by_revenue", by_sku.select("sku", "total_revenue", "total_qty").orderBy(F.desc("total_revenue"), "sku").limit(10))
    categories = by_price.where(F.col("category").isNotNull()).groupBy("category").agg(
        F.sum("rows").alias("count"), exact_sum("revenue").alias("total_revenue"), F.sum("qty").alias("total_qty"))
    save("category_counts", categories.select("category", "count").orderBy(F.desc("count"), "category"))
    save("top_categories_by_revenue", categories.drop("count").orderBy(F.desc("total_revenue"), "category").limit(10))
    save("price_histogram", distribution.histogram(by_price, "unit_price", 50, weight="qty", rows="rows"))
    save("price_density", distribution.density(by_price, "unit_price", 200, 50, rows="rows"))
    per_price = detail.groupBy("sku", "unit_price").agg(F.sum("qty").alias("qty"), F.sum("rows").alias("rows"))
    save("demand_curve", rollup.demand_curve(detail, curve_sku, "sku") if curve_sku is not None else rollup.busiest_curve_of(per_price, "sku"))
    for name, keys in (("revenue_by_month", ["year", "month"]), ("revenue_by_weekday", ["weekday"])):
        save(name, calendar.groupBy(*keys).agg(exact_sum("total_revenue").alias("total_revenue"), F.sum("total_qty").alias("total_qty"),
                                               F.sum("n_lines").alias("n_lines")).orderBy(*keys))

    # elasticity per SKU and per category
    sku_qty, sku_modes = segments.split_detail(detail, "sku")
    sku_pd = save("sku_price_demand", elasticity.with_logs(sku_qty))
    sku_el = save("sku_elasticity", elasticity.fit_elasticity(sku_pd, "sku"))
    save("sku_range_share", elasticity.range_share(sku_el))
    save("sku_peak_price", elasticity.peak_price(sku_pd, "sku"))
    qbp = by_price.where(F.col("category").isNotNull() & (F.col("unit_price") > 0)).select("category", "unit_price", "qty")
    cat_pd = save("category_price_demand", elasticity.with_logs(qbp.where(qbp.qty > 0)))
    cat_el = save("category_elasticity", elasticity.fit_elasticity(cat_pd, "category", r2_name="r_squared",
                                                                   with_points=True))
    save("category_range_counts", elasticity.range_counts(cat_el))

    # scenarios
    base_el = save("baseline", scenarios.with_elasticity(scenarios.baseline_from_price_demand(qbp), cat_el))
    grid = save("price_scenarios", scenarios.price_scenarios(base_el))
    save("price_pivot", scenarios.pivot_price_grid(grid))
    ev = save("evaluation", scenarios.evaluation(scenarios.promo_scenarios(base_el),
                                                 scenarios.peak_scenarios(base_el)))
    save("evaluation_pivot", scenarios.pivot_evaluation(ev, scenarios.scenario_labels()))

    # segments
    meta = save("sku_meta", sku_modes)
    seg = save("sku_segments", segments.segment_table(sku_el, meta))
    save("segment_stats", segments.segment_stats(seg))
    return paths


def main(argv: list[str] | None = None) -> None:
    from pricelab.plans.session import build_session
    from pricelab.sources import raw_sales_from_tables, read_sales_csv

    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv", help="raw sales export file(s), glob or folder")
    src.add_argument("--tables", help="folder of TPC-H style parquet tables (test mapping)")
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    ap.add_argument("--sku", default=None, help="SKU for the demand curve (default: the busiest)")
    ap.add_argument("--master", default=None)
    args = ap.parse_args(argv)
    spark = build_session(master=args.master, shuffle_partitions=None, cluster=args.master is None)
    raw = read_sales_csv(spark, args.csv) if args.csv else raw_sales_from_tables(spark, args.tables)
    order = "_row_order" if args.csv else F.col("order_id") * 1000 + F.col("line_no")
    for name, path in run_analysis(spark, raw, args.out, args.sku, order).items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
