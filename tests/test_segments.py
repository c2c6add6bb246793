import random
import statistics

import pytest

from pricelab.operators import segments
from pricelab.operators.stats import grouped_median


def test_modal_attributes_ties_nulls(spark):
    rows = [("tie", "b", "x", True), ("tie", "a", "x", False),
            ("allnull", None, None, None),
            ("nullmaj", None, "y", None), ("nullmaj", None, "y", True), ("nullmaj", "c", None, None)]
    fact = spark.createDataFrame(rows, "sku string, sales_channel string, fulfilled_by string, b2b boolean")
    got = {r.sku: r for r in segments.modal_attributes(fact).collect()}
    assert got["tie"].sales_channel == "a" and got["tie"].b2b_flag is False
    assert got["allnull"].sales_channel is None and got["allnull"].b2b_flag is None
    assert got["nullmaj"].sales_channel == "c" and got["nullmaj"].fulfilled_by == "y"
    assert got["nullmaj"].b2b_flag is True


def test_segment_table_drops_unsegmented(spark):
    el = spark.createDataFrame([("a", -0.5, 0.1, "Inelastic"), ("b", 2.0, 0.3, "Positive Elasticity"),
                                ("c", -3.0, 0.2, "Elastic")],
                               "sku string, elasticity double, r2 double, elasticity_range string")
    meta = spark.createDataFrame([("a", "amazon.in", "easy ship", False), ("b", "amazon.in", None, False)],
                                 "sku string, sales_channel string, fulfilled_by string, b2b_flag boolean")
    seg = segments.segment_table(el, meta)
    assert [r.sku for r in seg.collect()] == ["a"]


@pytest.mark.parametrize("cuts", [1000, 7, 2])
def test_grouped_median_exact(spark, cuts):
    rnd = random.Random(7)
    rows = []
    for g, n in (("hot", 3000), ("odd", 7), ("even", 8), ("one", 1), ("const", 50)):
        for _ in range(n):
            v = 5.0 if g == "const" else rnd.choice([rnd.gauss(0, 1), rnd.randint(-3, 3) * 1.0, 1e6])
            rows.append((g, v))
    rows += [("odd", None), ("odd", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.median for r in grouped_median(df, ["g"], "v", cuts=cuts).collect()}
    for g in ("hot", "odd", "even", "one", "const"):
        vals = [v for k, v in rows if k == g and v is not None and v == v]
        assert got[g] == pytest.approx(statistics.median(vals), abs=1e-12), g


def test_segment_stats_long_and_per_dimension(spark):
    rows = [("a", -1.0, "x", "p", True), ("b", -3.0, "x", "p", False), ("c", 2.0, "y", "p", False),
            ("d", 0.5, "x", "q", False)]
    seg = spark.createDataFrame(rows, "sku string, elasticity double, sales_channel string, "
                                      "fulfilled_by string, b2b_flag boolean")
    per = segments.segment_stats_for(seg, "sales_channel").collect()
    assert [r.sales_channel for r in per] == ["x", "y"]  # ascending mean
    assert per[0].n_skus == 3 and per[0].avg_elasticity == pytest.approx(-3.5 / 3)
    assert per[0].med_elasticity == -1.0
    long = {(r.dimension, r.value): r for r in segments.segment_stats(seg).collect()}
    assert long[("b2b_flag", "false")].n_skus == 3
    assert long[("b2b_flag", "false")].med_elasticity == 0.5
    assert long[("fulfilled_by", "p")].med_elasticity == -1.0


def test_one_pass_attributes_equal_modes(spark):
    from pricelab.operators import elasticity
    from pricelab.plans import queries as Q
    from tests.conftest import SF_SMALL
    f = Q.fact(spark, SF_SMALL)
    qbp, meta = segments.price_demand_and_attributes(f)
    a = {tuple(r) for r in segments.modal_attributes(f).collect()}
    b = {tuple(r) for r in meta.select("sku", "sales_channel", "fulfilled_by", "b2b_flag").collect()}
    assert a == b and len(a) > 0
    assert meta.schema["b2b_flag"].dataType.typeName() == "boolean"
    want = {tuple(r) for r in elasticity.quantity_by_price(f, "sku").collect()}
    assert {tuple(r) for r in qbp.collect()} == want


def test_one_pass_attribute_ties_and_nulls(spark):
    rows = [("tie", 1.0, "b", "x", True), ("tie", 2.0, "a", "x", False),
            ("allnull", 1.0, None, None, None),
            ("nullmaj", 1.0, None, "y", None), ("nullmaj", 2.0, None, "y", True), ("nullmaj", 3.0, "c", None, None)]
    fact = spark.createDataFrame(rows, "sku string, unit_price double, sales_channel string, fulfilled_by string, "
                                       "b2b boolean").withColumn("qty", __import__("pyspark.sql.functions",
                                                                                   fromlist=["lit"]).lit(1.0))
    _, meta = segments.price_demand_and_attributes(fact)
    got = {r.sku: r for r in meta.collect()}
    assert got["tie"].sales_channel == "a" and got["tie"].b2b_flag is False
    assert got["allnull"].sales_channel is None and got["allnull"].b2b_flag is None
    assert got["nullmaj"].sales_channel == "c" and got["nullmaj"].fulfilled_by == "y" and got["nullmaj"].b2b_flag is True


def test_grouped_median_of_extremes_and_null_groups(spark):
    inf, big = float("inf"), 1.7e308
    rows = [("inf", -inf), ("inf", 1.0), ("inf", inf), ("wide", -big), ("wide", 0.5), ("wide", big), (None, 4.0), (None, 6.0), ("none", None)]
    got = {r.g: r.median for r in grouped_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", cuts=3).collect()}
    assert got == {"inf": 1.0, "wide": 0.5, None: 5.0}


def test_grouped_median_of_many_groups(spark):
    df = spark.range(300_000).selectExpr("id % 100001 as g", "cast(id as double) as v")
    bad = grouped_median(df, ["g"], "v", cuts=4).selectExpr("g", "median", "g + 100001.0 * case when g < 99998 then 1 else 0.5 end as want").where("median <> want")
    assert bad.count() == 0


def test_null_prices_count_for_attributes(spark):
    rows = [("a", None, "x", "p", True), ("a", None, "x", "p", True), ("a", 1.0, "y", "p", False)]
    fact = spark.createDataFrame(rows, "sku string, unit_price double, sales_channel string, fulfilled_by string, b2b boolean").selectExpr("*", "1.0D as qty")
    qbp, meta = segments.price_demand_and_attributes(fact)
    assert meta.first().sales_channel == "x" and qbp.count() == 1


def test_one_chain_equals_fit_and_modes(spark):
    from pricelab.operators import elasticity
    from pricelab.plans import queries as Q
    from tests.conftest import SF_SMALL
    f = Q.fact(spark, SF_SMALL)
    cols = ["sku", "elasticity_range", "sales_channel", "fulfilled_by", "b2b_flag"]
    fit = elasticity.fit_elasticity(elasticity.price_demand(f, "sku"), "sku").join(segments.modal_attributes(f), "sku", "left")
    want = {tuple(r) for r in fit.selectExpr("round(elasticity, 9)", "round(r2, 9)", *cols).collect()}
    got = {tuple(r) for r in segments.elasticity_and_attributes(f).selectExpr("round(elasticity, 9)", "round(r2, 9)", *cols).collect()}
    assert got == want and len(got) > 100


def test_one_chain_modes_of_ties_and_nulls(spark):
    from pricelab.operators import elasticity
    rows = [("tie", 1.0 + i, v, f, b) for i, (v, f, b) in enumerate([("b", "x", True), ("a", "x", False), ("b", None, False), ("a", "y", True)])]
    rows += [("null", 1.0 + i, None, None, None) for i in range(3)]
    rows += [("half", 1.0 + i, None if i < 3 else "c", "y" if i % 2 else None, None if i else True) for i in range(4)]
    rows += [("split", 1.0 + i, "p" if i < 3 else "q", f"f{i % 3}", i < 2) for i in range(5)] + [("few", 1.0, "a", "b", True), (None, 1.0, "a", "b", True)] + [("null", None, "late", None, False)]
    fact = spark.createDataFrame(rows, "sku string, unit_price double, sales_channel string, fulfilled_by string, b2b boolean").selectExpr("*", "1.0D + unit_price % 3 as qty")
    cols = ["sku", "round(elasticity, 9)", "round(r2, 9)", "elasticity_range", "sales_channel", "fulfilled_by", "b2b_flag"]
    fit = elasticity.fit_elasticity(elasticity.price_demand(fact, "sku"), "sku").join(segments.modal_attributes(fact), "sku", "left")
    want = {tuple(r) for r in fit.selectExpr(*cols).collect()}
    got = segments.elasticity_and_attributes(fact)
    assert {tuple(r) for r in got.selectExpr(*cols).collect()} == want and len(want) == 4
    assert got.schema["b2b_flag"].dataType.typeName() == "boolean"


def test_a_fact_row_is_dealt_as_two_items(spark):
    from tests.test_skew import _shuffled_rows
    n = 20_000
    rows = spark.range(n).selectExpr("concat('S', id) AS sku", "1.0D + id AS unit_price", "1.0D AS qty", "'x' AS sales_channel", "'f' AS fulfilled_by", "true AS b2b")
    out = segments.elasticity_and_attributes(rows, min_points=1)
    assert out.count() == n
    out.collect()
    assert max(_shuffled_rows(out)) <= 2 * n
