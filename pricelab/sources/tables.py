"""Parquet table access for a directory of ``<name>.parquet`` tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Columns the fixture mapping reads, with their parquet types.  Declaring them
# skips the footer-inference job per table and reads only these columns.
KNOWN_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_returnflag string, l_linestatus string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_brand string, p_type string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
}


def read_table(spark: SparkSession, base_dir: str, name: str, schema: str | T.StructType | None = None,
               use_known_schema: bool = True) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it."""
    path = os.path.join(base_dir, f"{name}.parquet")
    schema = schema or (KNOWN_SCHEMAS.get(name) if use_known_schema else None)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)
