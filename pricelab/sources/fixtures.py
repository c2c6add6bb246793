"""Map the TPC-H style test tables onto the raw sales-export shape.

``lineitem ⨝ orders ⨝ part ⨝ customer`` gives one order line per row.  Headers
are spelled like the raw export (mixed case, blanks, hyphens, a trailing blank),
so header normalisation runs in every query.  Deterministic rules inject the
kinds of dirt the cleaning step must handle (missing amount, zero quantity,
missing date or style, padded/mixed-case text, missing fulfilment); they blank values,
they never remove rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelab.sources.tables import read_table

# Dirt-injection rule: order keys with these residues mod 97 get a blanked field.
DIRT_MODULUS = 97
NULL_AMOUNT_RESIDUE = 7
ZERO_QTY_RESIDUE = 11
NULL_DATE_RESIDUE = 13
NULL_STYLE_RESIDUE = 17


def raw_sales_from_tables(spark: SparkSession, base_dir: str) -> DataFrame:
    """One raw sales row per line item, with the raw export's column names."""
    li = read_table(spark, base_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_linestatus")
    orders = read_table(spark, base_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    part = read_table(spark, base_dir, "part").select("p_partkey", "p_brand", "p_type")
    cust = read_table(spark, base_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")

    # Large-large equi-join on the order key (sort-merge or shuffle-hash at scale);
    # the dimension joins are left to the planner: AQE broadcasts them at run time
    # only when their measured size is under the broadcast threshold.
    lines = (li.join(orders.hint("merge"), li.l_orderkey == orders.o_orderkey)
               .join(part, li.l_partkey == part.p_partkey)
               .join(cust, orders.o_custkey == cust.c_custkey))

    residue = F.col("l_orderkey") % DIRT_MODULUS
    status = (F.when(F.col("l_returnflag") == "R", F.lit("Cancelled"))
               .when(F.col("l_linestatus") == "F", F.lit("Shipped - Delivered to Buyer"))
               .otherwise(F.lit("Shipped")))
    channel = (F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit("  ")))
                .otherwise(F.concat(F.lower(F.col("c_mktsegment")), F.lit("\t"))))
    return lines.select(
        F.col("l_orderkey").alias("Order ID"),
        F.col("l_linenumber").alias("Line No"),
        F.when(residue != NULL_DATE_RESIDUE, F.col("o_orderdate")).alias("Date"),
        status.alias("Status"),
        channel.alias("Sales Channel "),
        # varies within a SKU, so that "first" depends on the order of rows
        F.when(residue != NULL_STYLE_RESIDUE, F.concat("p_brand", F.lit("/"), F.substring("o_orderpriority", 1, 1))).alias("Style"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string"), F.lit("-"),
                 (F.col("l_suppkey") % 10).cast("string")).alias("SKU"),
        F.col("p_type").alias("Category"),
        F.when(residue == ZERO_QTY_RESIDUE, F.lit(0.0)).otherwise(F.col("l_quantity")).alias("Qty"),
        F.when(residue != NULL_AMOUNT_RESIDUE, F.col("l_extendedprice")).alias("Amount"),
        F.col("c_nationkey").cast("string").alias("ship-city"),
        (F.col("c_nationkey") % 5 == 0).alias("B2B"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("fulfilled-by"),
    )
