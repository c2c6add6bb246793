import math

import pytest

from pricelab.operators import elasticity

E_VALUES = [1.157, 0.763, 0.301, -0.379, -0.599, -1.0, -2.0]


def _fact(spark, rows):
    return spark.createDataFrame(rows, "sku string, unit_price double, qty double")


def test_power_law_recovers_exponent(spark):
    rows = []
    for i, e in enumerate(E_VALUES):
        for p in (100.0, 150.0, 200.0, 400.0):
            rows.append((f"k{i}", p, 1e4 * p ** e))
    el = elasticity.fit_elasticity(elasticity.price_demand(_fact(spark, rows), "sku"), "sku")
    got = {r.sku: r for r in el.collect()}
    for i, e in enumerate(E_VALUES):
        assert got[f"k{i}"].elasticity == pytest.approx(e, abs=1e-9)
        assert got[f"k{i}"].r2 == pytest.approx(1.0, abs=1e-9)
    assert got["k5"].elasticity_range == "Elastic"  # exactly -1 is Elastic (right-closed)
    assert got["k3"].elasticity_range == "Inelastic"
    assert got["k0"].elasticity_range == "Positive Elasticity"


def test_constant_quantity_is_inelastic(spark):
    rows = [("c1", p, 1.0) for p in (10.0, 20.0, 30.0)] + [("c2", p, 2.0) for p in (5.0, 6.0, 7.0, 8.0)]
    got = {r.sku: r for r in elasticity.fit_elasticity(
        elasticity.price_demand(_fact(spark, rows), "sku"), "sku").collect()}
    for k in ("c1", "c2"):
        assert got[k].elasticity == 0.0 and got[k].r2 == pytest.approx(1.0)
        assert got[k].elasticity_range == "Inelastic"


def test_minimum_points_and_quantity_summed_per_price(spark):
    rows = [("two", 1.0, 1.0), ("two", 2.0, 1.0),
            ("three", 1.0, 4.0), ("three", 2.0, 2.0), ("three", 4.0, 1.0),
            # repeated price rows are summed before the fit: 3 distinct prices
            ("dup", 1.0, 2.0), ("dup", 1.0, 2.0), ("dup", 2.0, 2.0), ("dup", 4.0, 1.0)]
    got = {r.sku: r for r in elasticity.fit_elasticity(
        elasticity.price_demand(_fact(spark, rows), "sku"), "sku", with_points=True).collect()}
    assert set(got) == {"three", "dup"}
    assert got["three"].elasticity == pytest.approx(-1.0)
    assert got["dup"].n_price_points == 3
    assert got["dup"].elasticity == pytest.approx(-1.0)


def test_null_keys_vanish_and_positive_filter(spark):
    rows = [(None, 1.0, 1.0), (None, 2.0, 2.0), (None, 3.0, 3.0), ("a", 1.0, 1.0)]
    pdm = elasticity.price_demand(spark.createDataFrame(rows, "category string, unit_price double, qty double"),
                                  "category", positive_only=True)
    assert [r.category for r in pdm.collect()] == ["a"]
    r = pdm.first()
    assert r.log_price == 0.0 and r.log_qty == 0.0


def test_range_counts_include_empty_labels_and_share(spark):
    el = spark.createDataFrame([("a", -0.5, "Inelastic"), ("b", -0.2, "Inelastic"), ("c", 3.0, "Positive Elasticity")],
                               "sku string, elasticity double, elasticity_range string")
    counts = {r.elasticity_range: r["count"] for r in elasticity.range_counts(el).collect()}
    assert counts == {"Elastic": 0, "Inelastic": 2, "Positive Elasticity": 1}
    shares = {r.elasticity_range: r.share for r in elasticity.range_share(el).collect()}
    assert math.isclose(sum(shares.values()), 1.0)
    assert shares["Inelastic"] == pytest.approx(2 / 3)


def test_peak_price_ties_take_lowest_price(spark):
    rows = [("s", 700.0, 3.0), ("s", 735.0, 5.0), ("s", 720.0, 5.0), ("s", 800.0, 1.0)]
    pdm = elasticity.price_demand(_fact(spark, rows), "sku")
    r = elasticity.peak_price(pdm, "sku").first()
    assert r.peak_price == 720.0 and r.peak_qty == 5.0
