"""Incremental (key, unit price) -> Σ qty table from a stream of raw sales files.

The cleaning operator is stateless, so it runs unchanged on every micro-batch.  A batch adds its own
partial sums as one folder of the table (written again, not added twice, if the batch is retried); no state
grows in the executors and no earlier batch is rewritten.  Reading sums the partials, and
:func:`compact_price_demand` folds them into a new table when they have become many.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pricelab.operators.clean import sales_fact
from pricelab.operators.elasticity import quantity_by_price
from pricelab.plans.session import ensure_checkpoint_dir


def read_raw_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """File-source stream of raw sales rows (``fmt`` = parquet or csv; schema is required)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def run_price_demand(raw_stream: DataFrame, table_path: str, key: str = "sku",
                     checkpoint_location: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Start the query; every micro-batch adds its partial sums to the table at ``table_path``.

    ``available_now`` processes what is there and stops (scheduled runs);
    otherwise the query keeps running on new files.
    """
    if checkpoint_location is None:
        checkpoint_location = os.path.join(ensure_checkpoint_dir(raw_stream.sparkSession), "streams", f"price_demand_{key}")

    def publish(batch: DataFrame, epoch_id: int) -> None:
        quantity_by_price(sales_fact(batch), key).write.mode("overwrite").parquet(f"{table_path}/batch={epoch_id}")

    writer = raw_stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint_location).foreachBatch(publish)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_price_demand(spark: SparkSession, table_path: str, key: str = "sku") -> DataFrame:
    """Σ qty per (key, price) over all batches so far."""
    return spark.read.parquet(table_path).groupBy(key, "unit_price").agg(F.sum("qty").alias("qty"))


def compact_price_demand(spark: SparkSession, table_path: str, new_path: str, key: str = "sku") -> None:
    """Write the sums so far as one batch of a new table."""
    read_price_demand(spark, table_path, key).write.parquet(f"{new_path}/batch=0")
