import random

import numpy as np
from data import words

from reprise.llm import common


def test_words_and_their_hashes():
    texts = ["a bc  a\t\nbc", "", "bc é\U0001f600", " \x0b ", "a"]
    w = common.Words(texts)
    got = [["".join(map(chr, w.codes[s:e])) for s, e, r in zip(w.starts, w.ends, w.rows) if r == i] for i in range(len(texts))]
    assert got == [words(t) for t in texts]
    by_hash = {}
    for s, e, h in zip(w.starts, w.ends, w.hashes):
        by_hash.setdefault("".join(map(chr, w.codes[s:e])), set()).add(int(h))
    assert all(len(v) == 1 for v in by_hash.values()) and len({*map(min, by_hash.values())}) == len(by_hash)


def test_shingles_are_those_of_each_text():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 4, 5, 6, 30)]
    rows, hashes = common.shingles(common.Words(texts), 5)
    for i, t in enumerate(texts):
        w = words(t)
        want = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
        assert len(set(hashes[rows == i].tolist())) == len(want)
    alone = common.shingles(common.Words([texts[5]]), 5)[1]
    assert np.array_equal(np.sort(alone), np.sort(hashes[rows == 5]))


def test_hashes_do_not_depend_on_the_chunk():
    a, b = common.Words(["x yy zzz"]), common.Words(["filler " * 1000, "x yy zzz"])
    assert np.array_equal(a.hashes, b.hashes[b.rows == 1])
