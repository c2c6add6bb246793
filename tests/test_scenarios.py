import pytest
from pyspark.sql import functions as F

from pricelab.operators import scenarios

# Elasticities implied by the published price-grid results (invariant below inverted).
E = {"Western Dress": 1.157, "Blouse": 0.763, "Top": 0.301, "Bottom": -0.379, "Kurta": -0.599}


def _base(spark):
    rows = [(k, 100.0 + i, 1000.0 * (i + 1), e) for i, (k, e) in enumerate(E.items())]
    return spark.createDataFrame(rows, "category string, baseline_qty double, baseline_rev double, elasticity double")


def test_price_grid_invariant(spark):
    rows = scenarios.price_scenarios(_base(spark)).collect()
    assert len(rows) == 5 * len(E)
    for r in rows:
        m = r.multiplier
        assert r.rev_delta_pct == pytest.approx((m ** (1 + E[r.category]) - 1) * 100, rel=1e-12, abs=1e-9)
        if m == 1.0:
            assert r.rev_delta_pct == 0.0


def test_published_grid_values(spark):
    piv = {r.category: r for r in scenarios.pivot_price_grid(scenarios.price_scenarios(_base(spark))).collect()}
    assert piv["Western Dress"].pct_p5 == 11.1
    assert piv["Kurta"].pct_p10 == 3.9
    assert piv["Bottom"].pct_p10 == 6.1
    assert piv["Blouse"].pct_p10 == 18.3
    assert piv["Top"].pct_p10 == 13.2


def test_promo_matches_price_grid_and_peak_is_uplift(spark):
    base = _base(spark)
    grid = {(r.category, round(r.multiplier, 6)): r.rev_delta_pct for r in scenarios.price_scenarios(base).collect()}
    promo = scenarios.promo_scenarios(base).collect()
    assert {r.scenario for r in promo} == {"-9% discount", "-19% discount"}
    for r in promo:
        if r.multiplier == 0.9:
            assert r.rev_change_pct == pytest.approx(grid[(r.category, 0.9)], rel=1e-12)
    peak = scenarios.peak_scenarios(base).collect()
    for r in peak:
        assert r.rev_change_pct == pytest.approx((r.multiplier - 1) * 100, abs=1e-9)
    ev = scenarios.evaluation(scenarios.promo_scenarios(base), scenarios.peak_scenarios(base))
    assert ev.count() == 4 * len(E)
    piv = scenarios.pivot_evaluation(ev, scenarios.scenario_labels())
    assert piv.columns == ["category"] + scenarios.scenario_labels()
    assert {r["10% demand uplift"] for r in piv.collect()} == {10.0}


def test_baseline_revenue_is_price_times_qty_and_join_is_inner(spark):
    fact = spark.createDataFrame([("a", 10.0, 2.0), ("a", 5.0, 1.0), ("b", 1.0, 1.0), (None, 1.0, 1.0)],
                                 "category string, unit_price double, qty double")
    base = {r.category: r for r in scenarios.baseline(fact).collect()}
    assert set(base) == {"a", "b"}
    assert base["a"].baseline_qty == 3.0 and base["a"].baseline_rev == 25.0
    el = spark.createDataFrame([("a", -0.5)], "category string, elasticity double")
    joined = scenarios.with_elasticity(scenarios.baseline(fact), el).collect()
    assert [r.category for r in joined] == ["a"]


def test_pivot_rounds_half_even(spark):
    ev = spark.createDataFrame([("a", "s", 0.25), ("b", "s", 0.35), ("c", "s", -0.04)],
                               "category string, scenario string, rev_change_pct double")
    got = {r.category: r.s for r in scenarios.pivot_evaluation(ev, ["s"]).collect()}
    assert got["a"] == 0.2 and got["c"] == 0.0
    assert str(got["c"]) == "0.0"
    assert F is not None
