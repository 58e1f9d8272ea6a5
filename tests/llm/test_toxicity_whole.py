"""Operator 3 counts every word and pair of both classes: its measures of words by plain dictionaries."""

import math
import re
from collections import Counter

import pytest
from data import fold, frame
from test_learned import LABELS, planted

from reprise.llm import toxicity


def discount(values):
    values = list(values)
    one, two = values.count(1), values.count(2)
    return one / (one + 2 * two) if one else 0.5


def by_definition(labelled, scored):
    """word_mean, word_top and stem_plus of each text; labelled: (text, label)."""
    toks = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower()) if w]
    stem = lambda w: w[: toxicity.STEM] if w != "</s>" else w
    pairs, words, stems, members = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()], {}
    for text, k in labelled:
        ws = toks(text)
        pairs[k].update(zip(ws, ws[1:]))
        words[k].update([*ws, "</s>"] if ws else [])
    for k in (0, 1):
        for w, n in words[k].items():
            stems[k][stem(w)] += n
            members.setdefault(stem(w), set()).add(w)
    d, e, g = ([discount(x.values()) for x in xs] for xs in (pairs, words, stems))
    total, types = [x.total() for x in stems], sum(len(x) + 1 for x in members.values())
    back = [g[k] * len(stems[k]) / total[k] for k in (0, 1)]
    p_stem = lambda k, x: max(stems[k][x] - g[k], 0) / total[k] + back[k] * (len(members.get(x, ())) + 1) / (types + 1)
    inner = lambda k, x: 1 - sum(max(words[k][w] - e[k], 0) for w in members[x]) / stems[k][x] if stems[k][x] else 1.0
    known_words, known_pairs = words[0].keys() | words[1].keys(), pairs[0].keys() | pairs[1].keys()

    def p_word(k, w):
        x = stem(w)
        return p_stem(k, x) * ((max(words[k][w] - e[k], 0) / stems[k][x] if stems[k][x] else 0) + inner(k, x) / (len(members[x]) + 1))

    def ratio(w):
        x = stem(w)
        if w in known_words:
            return math.log(p_word(1, w) / p_word(0, w))
        return math.log(p_stem(1, x) / p_stem(0, x)) + math.log(inner(1, x) / inner(0, x)) if x in members else math.log(back[1] / back[0])

    def context(k, v):
        held = sum(max(n - d[k], 0) for p, n in pairs[k].items() if p[0] == v)
        return 1 - held / words[k][v] if words[k][v] else 1.0

    def joint(v, w):
        if (v, w) in known_pairs:
            p = [(max(pairs[k][v, w] - d[k], 0) / words[k][v] if words[k][v] else 0) + context(k, v) * p_word(k, w) for k in (0, 1)]
            return math.log(p[1] / p[0])
        return math.log(context(1, v) / context(0, v)) + ratio(w)

    for text in scored:
        ws = toks(text)
        chain = list(zip(["<s>", *ws], [*ws, "</s>"])) if ws else []
        tops = [ratio(w) for _, w in chain if w in known_words] + [joint(v, w) + ratio(v) for v, w in chain if (v, w) in known_pairs]
        plus = sum(max(math.log(p_stem(1, stem(w)) / p_stem(0, stem(w))) - toxicity.MARGIN, 0) for _, w in chain if stem(w) in members)
        yield (sum(joint(*p) for p in chain) / len(chain), max(tops or [0.0]), plus / len(chain)) if chain else (0.0, 0.0, 0.0)


@pytest.mark.parametrize("hot", [1 << 18, 20])
def test_every_word_and_pair_counts(spark, monkeypatch, hot):
    """Words and pairs that toxic texts have once or never are in the table too."""
    monkeypatch.setattr(toxicity, "HOT", hot)
    docs, labels = planted(60)
    docs += [(500, None, "en", "s", 1), (501, "ka mo ka mo unheard words", "en", "s", 1), (502, docs[0][1], "en", "s", 1), (503, "... !", "en", "s", 1)]
    label = {d: t for d, _, t in labels}
    learnable = [r for r in docs if fold(r[0]) != 0]
    pool = toxicity.labelled(frame(spark, learnable), spark.createDataFrame(labels, LABELS), "toxic")
    counts, columns = toxicity.materialize(toxicity.counted(pool), "counts"), ["ordinary", "toxic"]
    model = toxicity.word_model(counts, columns)
    got = toxicity.measured(frame(spark, docs), toxicity.symbol_model(counts, columns, toxicity.LATIN), *model, ["doc_id"], rounds=3 if hot == 20 else 1).collect()
    got = {r.doc_id: (r.word_mean, r.word_top, r.stem_plus) for r in got}
    for (d, *_), want in zip(docs, by_definition([(r[1], label[r[0]]) for r in learnable if r[0] in label], [r[1] for r in docs])):
        assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6) for a, b in zip(got[d], want)), (d, got[d], want)


def test_the_query_counts_all(spark, monkeypatch):
    """The counts that score have each pair of learnable texts, with the classes' counts."""
    docs, labels = planted(60)
    seen, word_model = [], toxicity.word_model
    read = lambda columns: toxicity.pair_counts(columns, lambda c0, c1: c0 + c1 > 0)

    def look(counts, columns, *rest):
        packed = counts.where(f"part = {toxicity.PAIRS}").collect()
        seen.append((Counter(pair for r in packed for pair in zip(*(x.tolist() for x in read(columns)(bytes(r.packed))[2:]))), rest))
        return word_model(counts, columns, *rest)

    monkeypatch.setattr(toxicity, "word_model", look)
    toxicity.score(frame(spark, docs), spark.createDataFrame(labels, LABELS), ["doc_id"]).collect()
    got, rest = seen[-1]
    label = {d: t for d, _, t in labels}
    want = [Counter(), Counter()]
    for d, text, *_ in docs:
        if fold(d) != 0:
            want[label[d]].update(zip(text.split(), text.split()[1:]))
    assert not rest and got == Counter((want[0][p], want[1][p]) for p in want[0].keys() | want[1].keys())
