"""Arrow batches cut by what their texts weigh."""

from __future__ import annotations

import pyarrow as pa

from tarnmill.functions.batches import slices


def test_slices_keep_every_row_in_order_and_are_small():
    texts = ["a" * n for n in (5, 0, 40, 3, 3, 3, 3, 0, 12)] + [None, "é" * 5]
    found = list(slices(iter([pa.RecordBatch.from_pydict({"text": texts})]), "text", 10))
    assert sum((b.column("text").to_pylist() for b in found), []) == texts
    assert all(b.num_rows == 1 or sum(len((x or "").encode()) for x in b.column("text").to_pylist()) <= 10 for b in found)
    assert list(slices(iter([pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())})]), "text")) == []
