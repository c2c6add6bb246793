import csv
import datetime as dt
import os
import tempfile

from pricelab.operators import clean
from pricelab.sources import read_sales_csv

RAW_COLS = "`Order ID` long, Date string, Status string, `Sales Channel ` string, Style string, SKU string, " \
           "Category string, Qty double, Amount double, `ship-city` string, B2B boolean, `fulfilled-by` string"


def _raw(spark, rows):
    return spark.createDataFrame(rows, RAW_COLS)


def test_dirty_rows(spark):
    nan = float("nan")
    rows = [
        (1, "04-30-22", "Shipped", " Amazon.in ", "S1", "A-1", "Kurta", 2.0, 100.0, "X", False, "Easy Ship"),
        (2, "31-05-22", "SHIPPED - Delivered to Buyer", "amazon.in\t", "S1", "A-1", "Kurta", 1.0, 60.0, "X", True, None),
        (3, "abc", "Shipped", "a", "S1", "A-1", "Kurta", 1.0, 60.0, "X", False, None),       # bad date
        (4, "04-30-22", "Cancelled", "a", "S1", "A-1", "Kurta", 1.0, 60.0, "X", False, None),  # status
        (5, "04-30-22", None, "a", "S1", "A-1", "Kurta", 1.0, 60.0, "X", False, None),         # null status
        (6, "04-30-22", " Shipped", "a", "S1", "A-1", "Kurta", 1.0, 60.0, "X", False, None),   # not trimmed
        (7, "04-30-22", "Shipped", "a", "S1", "A-1", "Kurta", 0.0, 60.0, "X", False, None),    # qty 0
        (8, "04-30-22", "Shipped", "a", "S1", "A-1", "Kurta", 1.0, -1.0, "X", False, None),    # amount < 0
        (9, "04-30-22", "Shipped", "a", "S1", "A-1", "Kurta", 1.0, nan, "X", False, None),     # NaN amount
        (10, "04-30-22", "Shipped", "a", "S1", None, "Kurta", 1.0, 60.0, "X", False, None),    # null sku
        (11, "04-30-22", "Shipped", "a", "S1", "A-1", "Kurta", None, 60.0, "X", False, None),  # null qty
    ]
    fact = clean.sales_fact(_raw(spark, rows))
    assert "ship_city" not in fact.columns and "ship-city" not in fact.columns
    got = {r.order_id: r for r in fact.collect()}
    assert sorted(got) == [1, 2]
    r1, r2 = got[1], got[2]
    assert r1.unit_price == 50.0 and r1.revenue == 100.0
    assert r1.sales_channel == "amazon.in" and r2.sales_channel == "amazon.in"
    assert r1.fulfilled_by == "easy ship" and r2.fulfilled_by is None
    assert r1.date == dt.datetime(2022, 4, 30) and r2.date == dt.datetime(2022, 5, 31)
    assert (r1.year, r1.month, r1.day, r1.weekday) == (2022, 4, 30, "Saturday")


def test_drop_ignores_absent_and_runs_before_rename(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Courier Status` int, `courier status` int, `ship-country` int")
    out = clean.normalize_columns(clean.drop_raw_columns(df))
    # only the raw spelling is dropped; the other column survives normalisation
    assert out.columns == ["courier_status"]


def test_csv_reader_normalises_headers(spark):
    d = tempfile.mkdtemp(prefix="pricelab-csv-")
    path = os.path.join(d, "sales.csv")
    header = ["index", "Order ID", "Date", "Status", "Fulfilment", "Sales Channel ", "Style", "SKU",
              "Category", "Courier Status", "Qty", "Amount", "ship-city", "B2B", "fulfilled-by", "Unnamed: 22",
              "extra col"]
    rows = [
        [0, "o1", "04-30-22", "Shipped", "Amazon", "Amazon.in", "S1", "A-1", "Set", "Shipped", "2", "100.5",
         "X", "False", "Easy Ship", "", "z"],
        [1, "o2", "05-01-22", "Cancelled", "Amazon", "Amazon.in", "S1", "A-1", "Set", "", "1", "10", "X",
         "True", "", "", "z"],
        [2, "o3", "junk", "Shipped", "Amazon", "Amazon.in", "S1", "A-1", "Set", "", "1", "10", "X", "True",
         "", "", "z"],
        [3, "o4", "05-02-22", "Shipped", "Merchant", " Non-Amazon", "S2", "B-1", "Kurta", "", "x", "10", "X",
         "TRUE", "", "", "z"],
        [4, "o5", "05-03-22", "shipped", "Merchant", "Non-Amazon ", "S2", "B-1", "Kurta", "", "3", "30", "X",
         "True", "", "", "z"],
    ]
    with open(path, "w", newline="") as fh:
        w = csv.writer(fh)
        w.writerow(header)
        w.writerows(rows)
    raw = read_sales_csv(spark, path)
    fact = clean.sales_fact(raw)
    assert "courier_status" not in fact.columns and "sales_channel" in fact.columns
    assert "extra_col" in fact.columns
    got = sorted((r.order_id, r.qty, r.amount, r.unit_price, r.b2b, r.sales_channel, r.fulfilled_by)
                 for r in fact.collect())
    assert got == [("o1", 2.0, 100.5, 50.25, False, "amazon.in", "easy ship"),
                   ("o5", 3.0, 30.0, 10.0, True, "non-amazon", None)]


def test_csv_row_order_drives_first_value(spark):
    from pricelab.operators import rollup
    d = tempfile.mkdtemp(prefix="pricelab-csv-")
    path = os.path.join(d, "sales.csv")
    with open(path, "w", newline="") as fh:
        w = csv.writer(fh)
        w.writerow(["Date", "Status", "SKU", "Style", "Category", "Qty", "Amount"])
        w.writerow(["04-30-22", "Shipped", "A-1", "", "Set", "1", "10"])
        w.writerow(["04-30-22", "Shipped", "A-1", "zeta", "Top", "1", "10"])
        w.writerow(["04-30-22", "Shipped", "A-1", "alpha", "Kurta", "1", "10"])
    fact = clean.sales_fact(read_sales_csv(spark, path))
    r = rollup.key_rollup(fact, "sku").first()
    assert (r.style, r.category) == ("zeta", "Set")  # first non-missing in file order, per column
