"""Operator 3 does its work once: a task's n-grams are one row each, and what the models need of pairs is counted with them."""

from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from reprise.llm import toxicity

TEXTS = ["one two one two", "two one three", "three three one two", "one", ""] * 3
CODES = [0, 1, 2, 3, 0] * 3
WORDLESS = SimpleNamespace(value=np.zeros(0, np.uint64))


def counted():
    """Blobs of a task whose batches have a text each."""
    batches = (pa.RecordBatch.from_arrays([pa.array([t]), pa.array([c], pa.int64())], ["text", "code"]) for t, c in zip(TEXTS, CODES))
    return sorted((b, x) for batch in toxicity._count(toxicity.LATIN, None, WORDLESS)(batches) for b, x in zip(*(batch.column(k).to_pylist() for k in (0, 1))))


def test_an_n_gram_is_a_row_a_task(monkeypatch):
    monkeypatch.setattr(toxicity, "_HELD", 8)  # words and pairs are written text by text
    seen, want = Counter(), Counter()
    for _, blob in counted():
        _, other, kind, n = toxicity.unpack_counted(blob, WORDLESS.value)
        seen.update({(int(g), int(k)): 1 for g, k in zip(other, kind) if k >> 2 == toxicity.SYMBOLS})
    owner, grams = toxicity.ngrams(TEXTS)
    want.update((int(g), CODES[o] + 4 * toxicity.SYMBOLS) for o, g in zip(owner, grams))
    assert seen == {k: 1 for k in want}


def test_pairs_of_a_word_are_counted_with_it():
    rows = counted()
    batch = pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "packed"])
    out = [r for x in toxicity._summed(0, WORDLESS)(iter([batch])) for r in x.to_pylist()]
    pairs = [Counter() for _ in range(4)]
    for t, c in zip(TEXTS, CODES):
        pairs[c].update(zip(t.split(), t.split()[1:]))
    sets = ((0, 2), (1, 3), (0,), (1,), (2,), (3,))  # as _COLUMNS
    sums = [sum((pairs[c] for c in s), Counter()) for s in sets]
    for w in ("one", "two", "three"):
        key = int(toxicity.word_pairs([w])[2][0].view(np.int64))
        (row,) = (r for r in out if r["part"] == toxicity.WORDS and r["second"] == key)
        own = [[n for (first, _), n in x.items() if first == w] for x in sums]
        assert [row[c] for c in toxicity._BEFORE] == [*map(sum, own[:4]), *map(len, own)]
    rare = sum(toxicity.unpack(r["packed"], np.int64)[0] for r in out if r["part"] == toxicity.RARE).reshape(3, 6, 2)
    assert rare[toxicity.PAIRS].tolist() == [[sum(n == m for n in x.values()) for m in (1, 2)] for x in sums]


def test_places():
    rng = np.random.default_rng(0)
    for n in (0, 1, 300):
        known = np.unique(np.r_[rng.integers(0, 1 << 63, n).astype(np.uint64), np.arange(n, dtype=np.uint64), np.full(min(n, 1), 2**64 - 1, np.uint64)])
        keys = np.r_[known, rng.integers(0, 1 << 63, 50).astype(np.uint64), np.array([0, 1, 2**64 - 1], np.uint64)]
        at, there = toxicity.Places(known).find(keys)
        assert there.tolist() == np.isin(keys, known).tolist() and (not n or (known[at[there]] == keys[there]).all())
