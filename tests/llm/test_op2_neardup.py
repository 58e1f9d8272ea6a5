import random
from fractions import Fraction

import numpy as np
import pytest
from data import awkward, bag, frame, words

from reprise.llm import neardup


def grams(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """[(doc_id, class_id, links)]: all pairs of rows."""
    sets = [grams(r[1]) for r in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common / (len(sets[i]) + len(sets[j]) - common) >= 0.8:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)] = min(ids.get(find(i), r[0]), r[0])
    return sorted(((r[0], ids.get(find(i)), links[i]) for i, r in enumerate(rows)), key=repr)


def near(rng, base, changes):
    w = base.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed, n=60):
    rng = random.Random(seed)
    bases = [" ".join(f"b{rng.randrange(500)}" for _ in range(rng.choice([6, 40, 120]))) for _ in range(8)]
    rows = [(i, near(rng, rng.choice(bases), rng.choice([0, 0, 1, 1, 2, 3, 6])), "en", "s", 1) for i in range(n)]
    return rows + [(1000, None, "en", "s", 1), (1001, "", "en", "s", 1), (1002, "", "en", "s", 1), (None, bases[0], "en", "s", 1), (1003, "one two", "en", "s", 1), (1004, "one  two", "en", "s", 1), rows[0]]


@pytest.mark.parametrize("seed", range(2))
def test_classes_and_links_by_all_pairs(spark, seed):
    rows = corpus(seed)
    assert bag(neardup.jaccard_classes(frame(spark, rows, extra=True)), "doc_id", "class_id", "links") == brute(rows)


def test_clusters_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_GRAMS", 300)
    rows = corpus(5, 50)
    assert bag(neardup.jaccard_classes(frame(spark, rows)), "doc_id", "class_id", "links") == brute(rows)


def test_awkward_rows(spark):
    rows = awkward()
    assert bag(neardup.jaccard_classes(frame(spark, rows)), "doc_id", "class_id", "links") == brute(rows)
    assert neardup.jaccard_classes(frame(spark, [])).count() == 0


def test_bands_reach_the_recall():
    bands, rows = neardup.banding(0.8, 0.9995, 160)
    assert bands * rows <= 160 and 1 - (1 - 0.8**rows) ** bands >= 0.9995
    assert rows > 1


@pytest.mark.parametrize("dense", [0, 3, 64])
def test_block_counts_by_sets(monkeypatch, dense):
    monkeypatch.setattr(neardup, "DENSE", dense)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30))).astype(np.uint64) for _ in range(20)]
    sizes = np.array([len(s) for s in sets])
    copies = rng.integers(1, 4, 20)
    for split in (20, 7):
        links, root = neardup.verify(np.concatenate(sets), sizes, copies, split, Fraction(1, 2))
        want, parent = np.zeros(20, dtype=int), list(range(20))
        for i in range(20):
            for j in range(i):
                if split < 20 and not (j < split <= i):
                    continue
                common = len(set(sets[i]) & set(sets[j]))
                if 2 * common >= sizes[i] + sizes[j] - common:
                    want[i] += copies[j]
                    want[j] += copies[i]
                    a, b = parent[i], parent[j]
                    parent = [min(a, b) if p in (a, b) else p for p in parent]
        assert (links == want).all() and (root == np.array(parent)).all()


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint"), "t").collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: parent[x] for x in touched}
