import math
import random

import numpy as np
import pytest

from pricelab.operators import distribution


def _df(spark, xs):
    return spark.createDataFrame([(x, 1.0) for x in xs], "unit_price double, qty double")


def test_histogram_matches_numpy(spark):
    rnd = random.Random(3)
    xs = [round(rnd.lognormvariate(6, 0.5), 2) for _ in range(2000)] + [1.0, 2500.0]
    hist = distribution.histogram(_df(spark, xs), bins=50).orderBy("bin").collect()
    counts, edges = np.histogram(xs, bins=np.histogram_bin_edges(xs, bins=50))
    assert [r["count"] for r in hist] == counts.tolist()
    assert [r.bin_lo for r in hist] == edges[:-1].tolist()
    assert hist[-1].bin_hi == edges[-1]
    assert sum(r.total_qty for r in hist) == len(xs)


def test_histogram_edge_values_and_constant_column(spark):
    xs = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]  # values on edges
    hist = distribution.histogram(_df(spark, xs), bins=5).orderBy("bin").collect()
    counts, _ = np.histogram(xs, bins=np.histogram_bin_edges(xs, bins=5))
    assert [r["count"] for r in hist] == counts.tolist()
    const = distribution.histogram(_df(spark, [7.0, 7.0, 7.0]), bins=4).orderBy("bin").collect()
    counts, edges = np.histogram([7.0] * 3, bins=np.histogram_bin_edges([7.0] * 3, bins=4))
    assert [r["count"] for r in const] == counts.tolist() and const[0].bin_lo == edges[0]


def test_density_matches_direct_formula(spark):
    rnd = random.Random(5)
    xs = [round(rnd.gauss(500, 120), 1) for _ in range(500)]
    out = distribution.density(_df(spark, xs), gridsize=200, bins=50).orderBy("grid_index").collect()
    x = np.array(xs)
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 200)
    dens = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
    counts, edges = np.histogram(x, bins=np.histogram_bin_edges(x, bins=50))
    norm = (counts * np.diff(edges)).sum()
    assert [r.unit_price for r in out] == pytest.approx(grid.tolist(), rel=1e-12)
    assert [r.density for r in out] == pytest.approx(dens.tolist(), rel=1e-9)
    assert [r.count_density for r in out] == pytest.approx((dens * norm).tolist(), rel=1e-9)


def test_modal_bin(spark):
    xs = [1.0, 1.1, 5.0, 5.1, 9.0]
    r = distribution.modal_bin(distribution.histogram(_df(spark, xs), bins=4)).first()
    assert r.bin == 1 and r["count"] == 2


def test_density_of_constant_or_single_value_is_null_not_an_error(spark):
    for xs in ([7.0, 7.0, 7.0], [3.0]):
        out = distribution.density(_df(spark, xs), gridsize=5, bins=4).collect()
        assert len(out) == 5 and all(r.density is None for r in out)


def test_density_far_gap_keeps_every_grid_point(spark):
    # a dense cluster and one far outlier: most grid points get exact zeros and stay in the output
    xs = [float(i % 50) for i in range(5000)] + [1e6]
    out = distribution.density(_df(spark, xs), gridsize=200, bins=50).orderBy("grid_index").collect()
    x = np.array(xs)
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 200)
    dens = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert len(out) == 200
    assert (dens == 0).sum() > 100
    assert [r.density for r in out] == pytest.approx(dens.tolist(), rel=1e-9, abs=1e-300)


def test_multiplicities_give_the_same_tables(spark):
    xs = [1.0, 1.0, 2.5, 7.0, 7.0, 7.0]
    reduced = spark.createDataFrame([(1.0, 2.0, 2), (2.5, 1.0, 1), (7.0, 3.0, 3)], "unit_price double, qty double, n long")
    a = distribution.histogram(_df(spark, xs), bins=4).orderBy("bin").collect()
    assert distribution.histogram(reduced, bins=4, rows="n").orderBy("bin").collect() == a
    d = [r.density for r in distribution.density(_df(spark, xs), gridsize=9, bins=4).orderBy("grid_index").collect()]
    assert [r.density for r in distribution.density(reduced, gridsize=9, bins=4, rows="n").orderBy("grid_index").collect()] == pytest.approx(d, rel=1e-12)
