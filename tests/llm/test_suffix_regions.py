"""Regions of one anchor whose hashes differ in the upper bits only stay apart."""

import numpy as np
import pyarrow as pa

from seedforest.llm import suffix_dedup


def test_all_64_bits_of_the_region_hash_count(monkeypatch):
    def regions(buffer, offsets, length, gram):
        first = offsets[:-1].astype(np.int64)
        return first, first + 20, first + 30, np.full(2, 7, np.uint64), np.array([5, 5 + (1 << 50)], np.uint64)

    monkeypatch.setattr(suffix_dedup, "regions", regions)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 0]), pa.array(["a" * 120, "b" * 120])], names=["doc", "crc", "text"])
    dealt = pa.Table.from_batches(list(suffix_dedup._anchors(100, 20, 64)(iter([batch]))))
    assert set(dealt.column("kind").to_pylist()) == {0}
    found = suffix_dedup._match_regions(dealt)
    assert sorted(found.column("doc").to_pylist()) == [1, 2] and min(found.column("anchor").to_pylist()) >= 0
