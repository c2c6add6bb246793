import os
import tempfile

from pyspark.sql import functions as F

from pricelab.operators.clean import sales_fact
from pricelab.operators.elasticity import quantity_by_price
from pricelab.sources.fixtures import raw_sales_from_tables
from pricelab.streaming import compact_price_demand, read_price_demand, read_raw_stream, run_price_demand
from tests.conftest import SF_SMALL


def test_stream_matches_batch(spark):
    root = tempfile.mkdtemp(prefix="pricelab-stream-")
    src, out, ckpt = (os.path.join(root, d) for d in ("src", "out", "ckpt"))
    raw = raw_sales_from_tables(spark, SF_SMALL)
    # two arrivals of files: even and odd order ids
    raw.where(F.col("Order ID") % 2 == 0).write.parquet(os.path.join(src, "part1"))
    stream = read_raw_stream(spark, os.path.join(src, "*"), raw.schema, max_files_per_trigger=1)
    q = run_price_demand(stream, out, "sku", checkpoint_location=ckpt)
    q.awaitTermination(300)
    first = read_price_demand(spark, out).count()
    raw.where(F.col("Order ID") % 2 == 1).write.parquet(os.path.join(src, "part2"))
    q = run_price_demand(read_raw_stream(spark, os.path.join(src, "*"), raw.schema), out, "sku",
                         checkpoint_location=ckpt)
    q.awaitTermination(300)
    got = read_price_demand(spark, out)
    want = quantity_by_price(sales_fact(raw), "sku")
    assert got.count() == want.count() > first
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    compact_price_demand(spark, out, out + "-compact")
    assert read_price_demand(spark, out + "-compact").exceptAll(want).count() == 0
