"""Output schemas of the derived tables."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelab.operators import elasticity, rollup, scenarios, segments
from pricelab.plans import queries as Q
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def fact(spark):
    return Q.fact(spark, SF_SMALL)


def _types(df):
    return {f.name: type(f.dataType) for f in df.schema.fields}


def test_sales_fact_schema(fact):
    t = _types(fact)
    for c in ("unit_price", "revenue", "qty", "amount"):
        assert t[c] is T.DoubleType
    for c in ("year", "month", "day", "weekofyear"):
        assert t[c] is T.IntegerType
    assert t["weekday"] is T.StringType and t["date"] is T.TimestampNTZType and t["b2b"] is T.BooleanType
    assert "ship_city" not in t


def test_derived_table_columns(fact):
    sku_el = elasticity.fit_elasticity(elasticity.price_demand(fact, "sku"), "sku")
    cat_el = elasticity.fit_elasticity(elasticity.price_demand(fact, "category", positive_only=True), "category",
                                       r2_name="r_squared", with_points=True)
    base = scenarios.with_elasticity(scenarios.baseline(fact), cat_el)
    meta = segments.modal_attributes(fact)
    expected = {
        "sku_agg": (rollup.key_rollup(fact, "sku", F.col("order_id") * 1000 + F.col("line_no")),
                    ["sku", "avg_price", "total_qty", "total_revenue", "style", "category"]),
        "sku_price_demand": (elasticity.price_demand(fact, "sku"), ["sku", "unit_price", "qty", "log_price", "log_qty"]),
        "elasticity_df": (sku_el, ["sku", "elasticity", "r2", "elasticity_range"]),
        "category_elasticity_df": (cat_el, ["category", "elasticity", "r_squared", "n_price_points",
                                            "elasticity_range"]),
        "baseline": (base, ["category", "baseline_qty", "baseline_rev", "elasticity"]),
        "scenario_df": (scenarios.price_scenarios(base), ["category", "price_change_pct", "baseline_revenue",
                                                           "simulated_revenue", "rev_delta_pct", "multiplier"]),
        "promo_df": (scenarios.promo_scenarios(base), ["category", "scenario", "baseline_rev", "sim_rev",
                                                       "rev_change_pct", "multiplier"]),
        "peak_df": (scenarios.peak_scenarios(base), ["category", "scenario", "baseline_rev", "sim_rev",
                                                     "rev_change_pct", "multiplier"]),
        "sku_meta": (meta, ["sku", "sales_channel", "fulfilled_by", "b2b_flag"]),
        "seg_df": (segments.segment_table(sku_el, meta), ["sku", "elasticity", "r2", "elasticity_range",
                                                          "sales_channel", "fulfilled_by", "b2b_flag"]),
    }
    for name, (df, cols) in expected.items():
        assert df.columns == cols, name
    assert _types(meta)["b2b_flag"] is T.BooleanType
    assert _types(cat_el)["n_price_points"] is T.LongType


def test_segment_stats_columns(fact):
    seg = segments.segment_table(elasticity.fit_elasticity(elasticity.price_demand(fact, "sku"), "sku"),
                                 segments.modal_attributes(fact))
    assert segments.segment_stats_for(seg, "b2b_flag").columns == ["b2b_flag", "n_skus", "avg_elasticity",
                                                                     "med_elasticity"]
    assert segments.segment_stats(seg).columns == ["dimension", "value", "n_skus", "avg_elasticity",
                                                   "med_elasticity"]
