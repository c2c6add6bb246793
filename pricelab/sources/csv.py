"""Raw sales CSV reader for one file, a folder or a glob.

Values are read as text (no inference pass) and typed later by the cleaning operator, whose coercions
turn unparsable values into NULL instead of failing the job.  Files are grouped by their header line
and read by column name, so files may order their columns differently or lack some.
"""

from __future__ import annotations

from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ORDER = "_row_order"
BAD_RECORD = "_bad_record"

# Cell texts that mean "missing".
MISSING_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                 "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

#: Header lines read at the same time.
HEADER_READS = 16

#: Row positions: fifteen digits for the file, thirteen for the block's first byte, ten for the row in the block.
WIDE = T.DecimalType(38, 0)
_ROWS = 10**10


def _plain(path: Column) -> Column:
    """File names with one spelling of the local scheme."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _place_in_file() -> Column:
    # a block is read by one task; the lower 33 bits count that task's rows
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return (F.col("_metadata.file_block_start").cast(WIDE) * F.lit(Decimal(_ROWS)) + row.cast(WIDE)).cast(WIDE)


def _headers(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """Column names of each file: its first line, read on its own (one small read for each file, ``HEADER_READS`` at a time)."""
    def columns(file: str) -> list[str]:
        return spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(file).columns

    with ThreadPoolExecutor(HEADER_READS) as pool:
        return dict(zip(files, pool.map(columns, files), strict=True))


def read_sales_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, header: bool = True,
                   with_row_order: bool = True, multi_line: bool = False, with_bad_records: bool = False) -> DataFrame:
    """All rows of the files under ``path`` (file, folder, glob or list), as text columns.

    With ``schema=None`` each file's header names its columns; files are read by name and a column that a file lacks
    is missing there.  A given ``schema`` says the columns of every file by position.  Cells that hold one of ``MISSING_WORDS``
    are missing.  ``multi_line`` accepts line breaks inside quotes (such a file is not split).
    ``with_row_order`` adds ``_row_order``, which grows in the order of file path, place in the file; ``with_bad_records`` adds the text
    of rows that do not fit their header as ``_bad_record`` (else NULL), to count them.
    """
    files = sorted(spark.read.format("binaryFile").load(path).select("path").inputFiles()) if not isinstance(path, list) else sorted(path)
    if not files and schema is None:
        raise ValueError(f"no files under {path}")
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    if schema is None:
        for f, columns in _headers(spark, files).items():
            groups[tuple(columns)].append(f)
    else:
        groups[tuple(schema.names)] = files
    types = {f.name: f.dataType for f in schema.fields} if schema else {}
    ranks = spark.createDataFrame([(f, i) for i, f in enumerate(files)], "_file string, _rank int").withColumn("_file", _plain(F.col("_file")))
    parts = [_read(spark, columns, own, types, header, multi_line, ranks if with_row_order else None) for columns, own in groups.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out if with_bad_records else out.drop(BAD_RECORD)


def _read(spark: SparkSession, columns: tuple[str, ...], files: list[str], types: dict, header: bool, multi_line: bool, ranks: DataFrame | None) -> DataFrame:
    # positional placeholders keep headers with equal or odd names apart while reading
    read = T.StructType([T.StructField(f"c{i}", types.get(c, T.StringType()), True) for i, c in enumerate(columns)] + [T.StructField(BAD_RECORD, T.StringType(), True)])
    df = (spark.read.schema(read).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_RECORD)
          .option("enforceSchema", True).option("multiLine", multi_line).option("escape", '"').csv(files))
    keep = []
    for i, c in enumerate(columns):
        cell = F.col(f"c{i}")
        if isinstance(types.get(c, T.StringType()), T.StringType):
            cell = F.when(~cell.isin(*MISSING_WORDS), cell)
        keep.append(cell.alias(c))
    if ranks is None:
        return df.select(*keep, BAD_RECORD)
    df = df.withColumn("_file", _plain(F.col("_metadata.file_path")))
    # one row per file name: the list was read on the driver
    placed = df.select("*", _place_in_file().alias("_place")).join(F.broadcast(ranks), "_file", "left")
    unknown = F.raise_error(F.concat(F.lit("row of an unlisted file: "), F.col("_file"))).cast(WIDE)
    rank = F.when(F.col("_rank").isNull(), unknown).otherwise(F.col("_rank").cast(WIDE) * F.lit(Decimal(_ROWS * 10**13)))
    return placed.select(*keep, BAD_RECORD, (rank + F.col("_place")).cast(WIDE).alias(ROW_ORDER))


def write_sales_csv(raw: DataFrame, path: str, date_format: str = "MM-dd-yyyy") -> None:
    """Write raw sales rows as an export-style CSV: header row, text dates, empty = missing."""
    out = raw
    for f in raw.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out = out.withColumn(f.name, F.date_format(F.col(f"`{f.name}`"), date_format))
    out.write.mode("overwrite").option("header", True).csv(path)
