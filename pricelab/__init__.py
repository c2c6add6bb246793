"""pricelab: price-elasticity and revenue-scenario analytics as Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, so Catalyst plans it and the work is partitioned by Spark.
"""

__version__ = "0.1.0"
