"""Inputs: raw sales CSV files and the parquet test tables mapped onto the raw sales shape."""

from pricelab.sources.csv import read_sales_csv, write_sales_csv  # noqa: F401
from pricelab.sources.fixtures import raw_sales_from_tables  # noqa: F401
from pricelab.sources.tables import read_table  # noqa: F401
