"""Algebraic invariants between operators, on the smallest table set."""

import pytest
from pyspark.sql import functions as F

from pricelab.operators import distribution, elasticity, rollup, scenarios
from pricelab.plans import queries as Q
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def fact(spark):
    return Q.fact(spark, SF_SMALL)


def test_rollup_qty_equals_baseline_qty(fact):
    total = rollup.key_rollup(fact, "sku", F.col("order_id") * 1000 + F.col("line_no")).agg(F.sum("total_qty")).first()[0]
    base = scenarios.baseline(fact, "category").agg(F.sum("baseline_qty")).first()[0]
    assert total == base == fact.agg(F.sum("qty")).first()[0]


def test_two_baseline_forms_agree(fact):
    a = {r.category: r for r in scenarios.baseline(fact, "category").collect()}
    b = {r.category: r for r in scenarios.baseline_from_price_demand(
        elasticity.quantity_by_price(fact, "category"), "category").collect()}
    assert set(a) == set(b)
    for k in a:
        assert a[k].baseline_qty == b[k].baseline_qty
        assert a[k].baseline_rev == pytest.approx(b[k].baseline_rev, rel=1e-9)


def test_histogram_counts_sum_to_rows_and_density_area(fact):
    n = fact.count()
    hist = distribution.histogram(fact, bins=50).collect()
    assert sum(r["count"] for r in hist) == n
    dens = distribution.density(fact, gridsize=200, bins=50).orderBy("grid_index").collect()
    area = sum((b.unit_price - a.unit_price) * (a.density + b.density) / 2 for a, b in zip(dens, dens[1:]))
    assert 0.8 < area <= 1.0001  # the grid stops at min/max (no cut beyond the data)


def test_range_counts_sum_to_fitted_keys(fact):
    el = elasticity.fit_elasticity(elasticity.price_demand(fact, "sku"), "sku")
    counts = elasticity.range_counts(el).agg(F.sum("count")).first()[0]
    assert counts == el.count() > 0
    shares = elasticity.range_share(el).agg(F.sum("share")).first()[0]
    assert shares == pytest.approx(1.0)


def test_price_grid_identity_on_real_baseline(spark):
    rows = Q.q_price_scenarios(spark, SF_SMALL).collect()
    el = {r.category: r.elasticity for r in Q.q_baseline_elasticity(spark, SF_SMALL).collect()}
    for r in rows:
        assert r.rev_delta_pct == pytest.approx((r.multiplier ** (1 + el[r.category]) - 1) * 100, abs=1e-5)
