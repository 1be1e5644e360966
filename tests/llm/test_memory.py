"""Memory of Python workers between tasks."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm._text import returned


def _resident() -> float:
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6


@pytest.mark.skipif(not Path("/proc/self/statm").exists(), reason="Linux only")
def test_workers_give_freed_memory_back():
    """200 MB in small arrays below one that stays: freed, they are not at the end of the heap."""

    def apply(batches):
        held = [np.ones(500) for _ in range(50_000)]
        kept.append(np.ones(500))
        assert len(held) == 50_000
        yield from batches

    kept: list = []
    batch = pa.record_batch({"x": [1, 2]})
    before = _resident()
    assert [b.num_rows for b in returned(apply)(iter([batch]))] == [2]
    assert _resident() - before < 60
