"""The CSV source over several files."""

import os
import tempfile

import pytest

from pricelab.operators import clean, rollup
from pricelab.plans import session
from pricelab.sources import read_sales_csv


def folder(**files):
    root = tempfile.mkdtemp(prefix="pricelab-csv-")
    for name, text in files.items():
        with open(os.path.join(root, f"{name}.csv"), "w") as f:
            f.write(text)
    return root


def test_rows_follow_the_order_of_files_not_of_sizes(spark):
    big = "SKU,Style,Category,unit_price,qty,revenue\n" + "k,b_second,c,1,1,1\n" * 400
    root = folder(a_first="SKU,Style,Category,unit_price,qty,revenue\nk,a_first,c,1,1,1\nk,other,c,1,1,1\n", b_second=big)
    df = clean.normalize_columns(read_sales_csv(spark, root)).selectExpr("*", "cast(unit_price as double) p").drop("unit_price").withColumnRenamed("p", "unit_price")
    df = df.selectExpr("sku", "style", "category", "unit_price", "cast(qty as double) qty", "cast(revenue as double) revenue", "_row_order")
    assert rollup.key_rollup(df, "sku").first().style == "a_first"
    order = [r.style for r in df.orderBy("_row_order").limit(3).collect()]
    assert order == ["a_first", "other", "b_second"]


def test_files_are_read_by_name(spark):
    root = folder(a="SKU,Style\nx,S1\n", b="Style,SKU\nS9,z\n", c="SKU\nonly\n")
    got = sorted(((r.SKU, r.Style) for r in read_sales_csv(spark, root + "/*.csv").collect()), key=str)
    assert got == [("only", None), ("x", "S1"), ("z", "S9")]


def test_missing_words(spark):
    words = ["NA", "NaN", "null", "None", "N/A", "n/a", "#N/A", "<NA>", "nan", "NULL", ""]
    root = folder(a="SKU,other\n" + "".join(f"{w},keep\n" for w in words) + "Nancy,keep\n")
    got = [r.SKU for r in read_sales_csv(spark, root).collect()]
    assert got == [None] * len(words) + ["Nancy"]


def test_quoted_line_breaks_and_bad_rows(spark):
    root = folder(a='SKU,Style\n"x\ny",S1\nz,S2\n')
    got = sorted((r.SKU, r.Style) for r in read_sales_csv(spark, root, multi_line=True).collect())
    assert got == [("x\ny", "S1"), ("z", "S2")]
    split = read_sales_csv(spark, root, with_bad_records=True).cache()
    assert split.where("_bad_record is not null").count() == 1  # the first half; the second looks like a row


def test_no_shared_folder_is_an_error_off_local(monkeypatch, spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        conf = spark.conf
        sparkContext = Context()  # noqa: N815

    if spark.conf.get("spark.checkpoint.dir", None):
        pytest.skip("a folder is configured")
    with pytest.raises(ValueError, match="checkpoint"):
        session.ensure_checkpoint_dir(Session())


def test_scratch_tables_can_be_dropped(spark):
    path = session.scratch_path(spark, "drop-me")
    spark.range(3).write.parquet(path)
    session.drop_scratch(spark, path)
    assert not os.path.exists(path.removeprefix("file:"))
    with pytest.raises(ValueError):
        session.drop_scratch(spark, "/tmp/elsewhere")


def test_headers_are_read_side_by_side():
    import threading
    from types import SimpleNamespace

    from pricelab.sources.csv import _headers
    met = threading.Barrier(2)

    class Reader:
        def option(self, *_):
            return self

        def csv(self, file):
            met.wait(20)  # breaks unless two reads are under way
            return SimpleNamespace(columns=[file])

    files = ["a", "b", "c", "d"]
    assert _headers(SimpleNamespace(read=Reader()), files) == {f: [f] for f in files}
