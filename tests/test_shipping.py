"""The package on the workers, and the entry module without the libraries of its optional part."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

WORKERS = """
import os, sys
sys.path.insert(0, {root!r})
from pricelab.plans.session import build_session, ship_package
spark = build_session(master="local[1]", shuffle_partitions=1)
ship_package(spark)
ship_package(spark)
from pricelab.functions import expressions
import pricelab.sources.tables as tables

def seen(batches):
    import pyarrow as pa
    for batch in batches:
        import pricelab.functions.expressions as found
        yield pa.RecordBatch.from_arrays([pa.array([found.__file__] * len(batch))], names=["f"])

print("FOUND", spark.range(1).mapInArrow(seen, "f string").first().f)
"""

ENTRY = """
import sys
sys.path.insert(0, {root!r})

class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in ("public_tokenizers", "tokenizers", "sentencepiece"):
            raise ModuleNotFoundError(name, name=name)

sys.meta_path.insert(0, Blocked())
import __spark_entry__ as e
print("QUERIES", len(e.queries()), "op6_packing" in e.queries(), len(e.oracle_sql()))
"""


def ran(code: str, cwd) -> str:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code.format(root=ROOT)], cwd=cwd, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout


def test_workers_find_the_package_without_a_path(tmp_path):
    out = ran(WORKERS, tmp_path)
    assert "FOUND" in out and ".zip" in out.split("FOUND")[1]


def test_entry_survives_missing_libraries(tmp_path):
    out = ran(ENTRY, tmp_path).split("QUERIES ")[1].split()
    assert int(out[0]) >= 45 and out[1] == "False" and int(out[2]) >= 45
