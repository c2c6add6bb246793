import os
import re

import numpy as np
import pyarrow as pa
import pytest

from pricelab.llm import common


def _held() -> float:
    """MB of private memory of this process."""
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPrivate_Dirty:\s+(\d+)", f.read()))) / 1024


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup") or common._trim() is None, reason="needs Linux and glibc")
def test_a_task_leaves_no_freed_memory_with_its_worker():
    kept = []

    def run(batches):
        for batch in batches:
            work = [np.ones(1000) for _ in range(30_000)]  # 240 MB in small pieces
            kept.extend(work[::100])  # what stays lies between what goes
            del work
            yield batch

    batch = pa.record_batch({"x": pa.array([1, 2])})
    before = _held()
    assert [b.num_rows for b in common.frugal(run)(iter([batch, batch]))] == [2, 2]
    assert _held() < before + 60


def test_memory_is_given_back_when_a_task_fails(monkeypatch):
    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append(1))

    def run(batches):
        yield next(batches)
        raise ValueError("stop")

    with pytest.raises(ValueError, match="stop"):
        list(common.frugal(run)(iter([1])))
    assert seen == [1]
