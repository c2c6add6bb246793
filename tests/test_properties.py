"""Property tests (hypothesis) against direct numpy / Python computations."""

import statistics

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pricelab.functions import bin_label
from pricelab.operators import distribution, elasticity
from pricelab.operators.stats import grouped_median

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
finite = st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False)


def _label(x):
    if x <= -1:
        return "Elastic"
    if x <= 0:
        return "Inelastic"
    return "Positive Elasticity"


@SETTINGS
@given(st.lists(finite, min_size=1, max_size=40))
def test_bin_label_matches_python(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "e double")
    assert [r[0] for r in df.select(bin_label("e")).collect()] == [_label(x) for x in xs]


@SETTINGS
@given(st.lists(st.floats(min_value=0.01, max_value=5000, allow_nan=False), min_size=1, max_size=300),
       st.integers(min_value=1, max_value=60))
def test_histogram_matches_numpy(spark, xs, bins):
    df = spark.createDataFrame([(x, 1.0) for x in xs], "unit_price double, qty double")
    got = [r["count"] for r in distribution.histogram(df, bins=bins).orderBy("bin").collect()]
    want, _ = np.histogram(xs, bins=np.histogram_bin_edges(xs, bins=bins))
    assert got == want.tolist()


@SETTINGS
@given(st.dictionaries(st.sampled_from("abcde"), st.lists(finite, min_size=1, max_size=60), min_size=1),
       st.sampled_from([1000, 7, 2]))
def test_grouped_median_matches_statistics(spark, groups, params):
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.median for r in grouped_median(df, ["g"], "v", cuts=params).collect()}
    for g, vs in groups.items():
        assert got[g] == pytest.approx(statistics.median(vs), rel=1e-12, abs=1e-9)


@SETTINGS
@given(st.lists(st.tuples(st.floats(min_value=1, max_value=1000), st.floats(min_value=1, max_value=100)),
                min_size=3, max_size=30, unique_by=lambda t: t[0]))
def test_slope_matches_polyfit(spark, pts):
    df = spark.createDataFrame([("k", p, q) for p, q in pts], "sku string, unit_price double, qty double")
    r = elasticity.fit_elasticity(elasticity.price_demand(df, "sku"), "sku").first()
    x, y = np.log([p for p, _ in pts]), np.log([q for _, q in pts])
    if np.ptp(x) < 1e-9:
        return
    slope = np.polyfit(x, y, 1)[0]
    assert r.elasticity == pytest.approx(slope if abs(slope) >= 1e-12 else 0.0, rel=1e-6, abs=1e-7)
