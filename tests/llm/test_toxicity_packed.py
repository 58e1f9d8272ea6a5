"""Operator 3's packed rows: answers are a row for each block of texts, counted rows write frequent words short."""

import numpy as np
import pyarrow as pa

from reprise.llm import toxicity


def asks(bucket, block, keys, rows):
    pack = toxicity.pack
    return bucket, block, pack(keys, np.full(len(keys), len(rows), np.uint32)), pack(np.tile(rows, len(keys)).astype(np.uint32), np.ones(len(keys) * len(rows), np.uint32))


def test_answers_are_a_row_for_each_block():
    """Not a row for each text in each task, which are texts times tasks."""
    keys, values = np.arange(1, 6, dtype=np.uint64), np.arange(1, 6, dtype=np.float32)
    table = toxicity.pack(keys, values, -values, np.zeros(5, np.float32), np.ones(5, np.uint32))
    rows = [(b, *x) for b in range(3) for x in [(None, table, None), asks(b, 0, keys[:2], np.arange(500))[1:], asks(b, 7 << 33, keys[2:], np.arange(400))[1:]]]
    batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "block", "packed", "asking"])
    got = [r for b in toxicity._answers(iter([batch])) for r in b.to_pylist()]
    assert len(got) == 2
    for r, size, total, top in zip(got, (500, 400), (3 * 3, 3 * 12), (-1, -3)):
        row, sums, plus, best = toxicity.unpack(r["packed"], *toxicity._ANSWERS)
        assert row.tolist() == list(range(size)) and set(sums) == {total} and set(plus) == {0} and set(best) == {top}


def test_counted_rows_with_any_list():
    rng = np.random.default_rng(0)
    lead, other = np.sort(rng.integers(0, 1 << 63, 300).astype(np.uint64)), rng.integers(0, 1 << 63, 300).astype(np.uint64)
    kind, n, sizes = (rng.integers(0, 16, 300)).astype(np.uint8), rng.integers(1, 9, 300), []
    for words in (other[:0], np.unique(other[:200]), np.unique(other)):
        at, listed = toxicity.find(words, other)
        blob = toxicity.pack_counted(lead, np.where(listed, at, toxicity.WRITTEN).astype(np.uint16), other, kind, n)
        assert all((a == b).all() for a, b in zip(toxicity.unpack_counted(blob, words), (lead, other, kind, n)))
        sizes.append(len(blob))
    assert sizes[0] > sizes[1] > sizes[2]


def test_order_with_shared_leading_bits():
    """Keys that differ in their last bits only are never taken for one."""
    lead = np.tile(np.array([5, 6, 5 << 50], np.uint64), 200)
    other = np.repeat(np.arange(1, 7, dtype=np.uint64), 100)
    order = toxicity._by_lead(lead, other)
    assert len(toxicity._firsts(lead[order], other[order])) == 18 and (np.diff(lead[order].astype(float)) >= 0).all()
    at, which = toxicity._distinct(other)
    assert (other[at][which] == other).all()
