"""What a task's function holds at its peak, and what a worker that waits for its next task still holds."""

from __future__ import annotations

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.pandas.group_ops import PandasCogroupedOps, PandasGroupedOpsMixin

from tallymark.llm import recompression, suffixes
from tallymark.llm.common import release
from tallymark.llm.words import Batch


def texts(n: int, words: int) -> list[str]:
    rng = np.random.default_rng(3)
    return [" ".join(map(str, rng.integers(0, 1 << 20, words))) for _ in range(n)]


def held() -> float:
    """MB of this process, without mapped files."""
    with open("/proc/self/smaps_rollup") as lines:
        return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", lines.read()))) / 1024


@pytest.mark.parametrize("module", [recompression, suffixes], ids=["recompression", "suffixes"])
def test_a_waiting_worker_holds_no_arrays_of_its_last_group(spark, monkeypatch, module):
    found = []
    for kind in (PandasGroupedOpsMixin, PandasCogroupedOps):
        monkeypatch.setattr(kind, "applyInArrow", lambda self, f, schema, put=kind.applyInArrow: found.append(f) or put(self, f, schema))
    module.dedup(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    rows = texts(250, 2500)
    kind = pa.string() if module is recompression else pa.binary()
    part = pa.table({"doc_id": pa.array(range(250), pa.int64()), "text": pa.array(rows, kind), "_row": pa.array(range(250), pa.int64()), "chunk": pa.array([0] * 250, pa.int64())})
    found[0]((0,), part)  # reads the chunk and sends its names
    after = held()
    release()
    assert after - held() < 15


def test_kept_texts_need_few_bytes_beside_their_texts():
    rows = [t.encode() for t in texts(250, 2500)]
    batch = Batch(rows)
    keep = np.arange(len(batch.starts)) % 3 > 0
    tracemalloc.start()
    got = recompression.kept_texts(batch, keep)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * sum(map(len, rows))
    split = [t.split() for t in rows]
    first = np.cumsum([0, *map(len, split)])
    assert got == [b" ".join(w for w, k in zip(s, keep[a:], strict=False) if k) for s, a in zip(split, first, strict=False)]
    for few in ([], [b""], [b"", b"a", b""], [b" a  b ", b""]):
        b = Batch(few)
        assert recompression.kept_texts(b, np.ones(len(b.starts), bool)) == [b" ".join(t.split()) for t in few]
