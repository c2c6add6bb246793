"""Physical-plan checks: what every registered query must (not) contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from pricelab.plans.queries import QUERIES
from tests.conftest import SF_SMALL

FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
             "CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cross_join(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    for node in FORBIDDEN:
        assert node not in plan, f"{name}: {node}"


def test_elasticity_aggregates_combine_map_side(spark):
    plan = _plan(E.queries()["sku_elasticity"](spark, SF_SMALL))
    assert "partial_sum" in plan and "partial_regr_slope" in plan and "partial_regr_r2" in plan


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(E.queries()["sku_elasticity"](spark, SF_SMALL))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "lineitem" in line]
    assert scans
    for s in scans:
        for unused in ("l_tax", "l_discount", "l_shipdate", "l_linenumber"):
            assert unused not in s.split("ReadSchema")[-1]


def _nodes(node):
    """Nodes of the plan that ran: into query stages and subqueries, not into reused ones."""
    name = node.nodeName()
    if name.startswith(("ReusedExchange", "ReusedSubquery")):
        return
    yield node
    if name == "AdaptiveSparkPlan":
        below = [node.executedPlan()]
    elif "QueryStage" in name:
        below = [node.plan()]
    else:
        children = node.children()
        below = [children.apply(i) for i in range(children.size())]
    subqueries = node.subqueries()
    below += [subqueries.apply(i) for i in range(subqueries.size())]
    for x in below:
        yield from _nodes(x)


def _ran(df) -> list[str]:
    df.collect()
    return [n.simpleString(10_000) for n in _nodes(df._jdf.queryExecution().executedPlan())]


@pytest.mark.parametrize("name", ["evaluation_pivot", "price_pivot", "sku_demand_curve", "sku_segments", "price_histogram", "price_density"])
def test_shared_pre_aggregate_scans_the_fact_once(spark, name):
    ran = _ran(E.queries()[name](spark, SF_SMALL))
    assert sum("FileScan" in n and "lineitem.parquet" in n for n in ran) == 1, name


@pytest.mark.parametrize("name", ["price_histogram", "demand_by_price_bin", "modal_price_bin", "price_density"])
def test_rows_are_not_shuffled_by_price(spark, name):
    ran = _ran(E.queries()[name](spark, SF_SMALL))
    assert not any(re.search(r"Exchange hashpartitioning\((x|unit_price)#", n) for n in ran), name


def _below_exchanges(node, below=0):
    """(plan node, number of aggregating exchanges beneath it) of the plan that ran."""
    name = node.nodeName()
    if name.startswith("ReusedExchange"):  # its own rows are judged where they are made
        return [], 1
    if name == "AdaptiveSparkPlan":
        children = [node.executedPlan()]
    elif "QueryStage" in name:
        children = [node.plan()]
    else:
        own = node.children()
        children = [own.apply(i) for i in range(own.size())]
    found, most = [], 0
    for child in children:
        nodes, n = _below_exchanges(child)
        found += nodes
        most = max(most, n)
    found.append((node, most))
    dealt = name == "Exchange" and any("Aggregate" in c.toString().splitlines()[0] for c in children)
    return found, most + dealt


@pytest.mark.parametrize("name", ["sku_rollup", "sku_peak_price", "sku_segments", "segment_stats_channel"])
def test_fact_rows_are_hash_aggregated_and_not_dealt_by_the_key(spark, name):
    """Below the first exchange of an aggregate all aggregates are by hash, and rows are dealt by more than the key."""
    df = E.queries()[name](spark, SF_SMALL)
    df.collect()
    nodes, _ = _below_exchanges(df._jdf.queryExecution().executedPlan())
    first = [n for n, below in nodes if below == 0]
    assert any(n.nodeName().startswith("HashAggregate") for n in first)
    assert not any(n.nodeName().startswith("SortAggregate") for n in first)
    for n, _ in nodes:
        if n.nodeName() == "Exchange" and "hashpartitioning(sku#" in n.simpleString(10_000).split(",")[0] and re.search(r"hashpartitioning\(sku#\d+, \d+\)", n.simpleString(10_000)):
            child = n.children().apply(0).toString().splitlines()
            assert any("partial_" in line for line in child[:3]), name  # only merged buffers are dealt by the key


def test_segment_statistics_have_a_short_plan(spark):
    ran = _ran(E.queries()["segment_stats_channel"](spark, SF_SMALL))
    exchanges = [n for n in ran if n.startswith("Exchange ")]
    assert len(exchanges) <= 9, exchanges


@pytest.mark.parametrize("name", ["segment_stats_channel", "segment_stats_fulfilment", "segment_stats_b2b", "segment_stats"])
def test_skus_are_merged_once_for_both_passes(spark, name):
    ran = _ran(E.queries()[name](spark, SF_SMALL))
    assert sum("regr_slope(" in n and "partial_regr_slope" not in n for n in ran if "Aggregate" in n.split("(")[0]) == 1


def test_eager_jobs_use_no_python(spark):
    """Queries that run jobs while they are built: the plans of those jobs, too."""
    seen = []
    bus = spark._jsparkSession.listenerManager()

    class Listener:
        def onSuccess(self, name, execution, duration):  # noqa: N802
            seen.append(execution.executedPlan().toString())

        def onFailure(self, name, execution, error):  # noqa: N802
            seen.append(execution.executedPlan().toString())

        class Java:
            implements = ["org.apache.spark.sql.util.QueryExecutionListener"]

    gateway = spark.sparkContext._gateway
    from pyspark.java_gateway import ensure_callback_server_started
    ensure_callback_server_started(gateway)
    listener = Listener()
    bus.register(listener)
    try:
        for name in ("csv_clean_sales", "csv_many_files", "segment_stats", "sku_demand_curve_for"):
            E.queries()[name](spark, SF_SMALL).agg(F.count(F.lit(1))).collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        bus.unregister(listener)
    assert seen
    for plan in seen:
        for node in FORBIDDEN:
            assert node not in plan
