"""A key holding a third of all rows: results equal a brute-force pandas computation."""

import numpy as np
import pandas as pd
import pytest

from pricelab.operators import elasticity, segments


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(11)
    n = 9000
    hot = n // 3
    sku = np.array(["HOT"] * hot + [f"S{i % 600}" for i in range(n - hot)])
    price = rng.choice([100.0, 110.0, 120.0, 130.0, 140.0], size=n) + (sku != "HOT") * rng.integers(0, 3, n)
    qty = rng.integers(1, 5, n).astype(float)
    channel = rng.choice(["amazon.in", "non-amazon"], size=n, p=[0.7, 0.3])
    fulfil = rng.choice(["easy ship", None], size=n, p=[0.6, 0.4])
    b2b = rng.random(n) < 0.2
    pdf = pd.DataFrame({"sku": sku, "unit_price": price, "qty": qty, "sales_channel": channel,
                        "fulfilled_by": fulfil, "b2b": b2b})
    df = spark.createDataFrame(pdf).repartition(8)
    return pdf, df


def _brute_slopes(pdf):
    g = pdf.groupby(["sku", "unit_price"], as_index=False)["qty"].sum()
    out = {}
    for k, grp in g.groupby("sku"):
        if len(grp) >= 3:
            out[k] = np.polyfit(np.log(grp.unit_price), np.log(grp.qty), 1)[0]
    return out


def _brute_mode(series):
    vals = series.dropna()
    return None if vals.empty else sorted(vals.value_counts()[lambda c: c == c.max()].index)[0]


def test_hot_key_elasticity_and_attributes(spark, skewed):
    pdf, df = skewed
    qbp, meta = segments.price_demand_and_attributes(df)
    el = {r.sku: r.elasticity for r in elasticity.fit_elasticity(elasticity.with_logs(qbp), "sku").collect()}
    want = _brute_slopes(pdf)
    assert set(el) == set(want)
    for k, v in want.items():
        assert el[k] == pytest.approx(v, abs=1e-9)
    got = {r.sku: r for r in meta.collect()}
    for k, grp in pdf.groupby("sku"):
        assert got[k].sales_channel == _brute_mode(grp.sales_channel)
        assert got[k].fulfilled_by == _brute_mode(grp.fulfilled_by)
        assert got[k].b2b_flag == _brute_mode(grp.b2b)


def test_hot_segment_median(spark, skewed):
    pdf, df = skewed
    qbp, meta = segments.price_demand_and_attributes(df)
    el = elasticity.fit_elasticity(elasticity.with_logs(qbp), "sku")
    seg = segments.segment_table(el, meta)
    got = {r.sales_channel: r for r in segments.segment_stats_for(seg, "sales_channel").collect()}
    s = seg.toPandas()
    for k, grp in s.groupby("sales_channel"):
        assert got[k].n_skus == len(grp)
        assert got[k].med_elasticity == pytest.approx(grp.elasticity.median(), abs=1e-12)
        assert got[k].avg_elasticity == pytest.approx(grp.elasticity.mean(), abs=1e-12)


def test_hot_key_with_prices_of_its_own_is_spread(spark):
    """A SKU with a third of the rows, each at its own price: no task gets more than a small share of them."""
    n = 60_000
    rows = spark.range(n).selectExpr("if(id % 3 = 0, 'HOT', concat('S', id % 4001)) AS sku", "1.0D + id AS unit_price", "1.0D + id % 5 AS qty",
                                     "if(id % 2 = 0, 'x', 'y') AS sales_channel", "'f' AS fulfilled_by", "id % 7 = 0 AS b2b")
    out = segments.elasticity_and_attributes(rows)
    assert out.where("sku = 'HOT'").first().sales_channel == "x"
    got = {r.sku: r.n_price_points for r in out.collect()}
    assert got["HOT"] == n // 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("sku#" in line and "p#" in line and "v#" in line for line in dealt)
    # what is dealt by the key alone has one row for each key and task, not one for each price
    sizes = _shuffled_rows(out)
    assert min(sizes) <= 4002 * 8 < max(sizes)


def _shuffled_rows(df) -> list[int]:
    """Rows written by each exchange of the plan that ran."""
    found = []

    def walk(node):
        name = node.nodeName()
        if name == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found
