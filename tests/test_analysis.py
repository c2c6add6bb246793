import glob
import json
import os
import subprocess
import sys
import tempfile

from pyspark.sql import functions as F

from pricelab.plans import queries as Q
from pricelab.plans.analysis import run_analysis
from pricelab.sources import raw_sales_from_tables
from tests.conftest import SF_SMALL


def test_full_analysis_writes_every_table(spark):
    out = tempfile.mkdtemp(prefix="pricelab-analysis-")
    paths = run_analysis(spark, raw_sales_from_tables(spark, SF_SMALL), out, order=F.col("order_id") * 1000 + F.col("line_no"))
    assert len(paths) == 30 and all(os.path.isdir(p) for p in paths.values())
    piv = {r.category: r for r in spark.read.parquet(paths["evaluation_pivot"]).collect()}
    want = {r.category: r for r in Q.q_evaluation_pivot(spark, SF_SMALL).collect()}
    assert piv == want
    assert spark.read.parquet(paths["sku_elasticity"]).count() == Q.q_sku_elasticity(spark, SF_SMALL).count()
    seg = {(r.dimension, r.value): r.n_skus for r in spark.read.parquet(paths["segment_stats"]).collect()}
    want = {(r.dimension, r.value): r.n_skus for r in Q.q_segment_stats(spark, SF_SMALL).collect()}
    assert seg == want
    top = [tuple(r) for r in spark.read.parquet(paths["top_skus_by_revenue"]).select("sku", F.round("total_revenue", 2), "total_qty").collect()]
    assert sorted(top) == sorted(tuple(r) for r in Q.q_top_skus_by_revenue(spark, SF_SMALL).select("sku", "total_revenue", "total_qty").collect())
    bins = {r.bin: (r["count"], r.total_qty) for r in spark.read.parquet(paths["price_histogram"]).collect()}
    assert bins == {r.bin: (r["count"], r.total_qty) for r in Q.q_demand_by_price_bin(spark, SF_SMALL).collect()}
    dens = {r.grid_index: round(r.density, 12) for r in spark.read.parquet(paths["price_density"]).collect()}
    assert dens == {r.grid_index: r.density for r in Q.q_price_density(spark, SF_SMALL).collect()}


def test_fact_is_read_four_times():
    """Counted in the event log of a run of its own."""
    root = tempfile.mkdtemp(prefix="pricelab-events-")
    code = f"""
from pyspark.sql import functions as F
from pricelab.plans.session import build_session
from pricelab.plans.analysis import run_analysis
from pricelab.sources import raw_sales_from_tables
spark = build_session("local[2]", 4, extra={{"spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://{root}", "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false", "spark.sql.maxMetadataStringLength": "4000"}})
run_analysis(spark, raw_sales_from_tables(spark, {SF_SMALL!r}), "{root}/out", order=F.col("order_id") * 1000 + F.col("line_no"))
spark.stop()
"""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=here, check=True, env=os.environ | {"PYTHONPATH": here})
    def scans(node: dict) -> int:
        own = node["nodeName"].startswith("Scan parquet") and "out/sales_fact" in node.get("metadata", {}).get("Location", "")
        return int(own) + sum(map(scans, node["children"]))

    reads = 0
    for path in glob.glob(f"{root}/local-*"):
        last: dict[int, dict] = {}
        for line in open(path):
            event = json.loads(line)
            if "sparkPlanInfo" in event:  # the last plan of an execution is the one that ran
                last[event["executionId"]] = event["sparkPlanInfo"]
        reads += sum(map(scans, last.values()))
    assert 4 <= reads <= 6
