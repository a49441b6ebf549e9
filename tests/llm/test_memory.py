import re

import numpy as np
import pyarrow as pa

from tidemark.llm import common


def resident():
    with open("/proc/self/status") as f:
        return int(re.search(r"VmRSS:\s+(\d+)", f.read())[1]) >> 10


def test_tidy_leaves_no_freed_memory_behind():
    """What a task freed in many small pieces goes back to the system, but not before its rows are out."""

    def run(batches):
        for batch in batches:
            parts = [np.ones(4000) for _ in range(6000)]  # 190 MB in pieces that the C library keeps
            kept.append(parts[-1])
            yield pa.RecordBatch.from_arrays([pa.array([len(parts)])], ["n"])

    kept = []
    before = resident()
    assert [b.column(0)[0].as_py() for b in common.tidy(run)(iter([None, None]))] == [6000, 6000]
    assert resident() < before + 60
