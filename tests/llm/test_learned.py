"""Operators 3, 4 and 7: models by their definitions, held-out results, and awkward rows."""

import math
import random

import numpy as np
import pytest
from data import DOCS, awkward, bag, fold, frame

from reprise.llm import langid, quality_mil, toxicity

FOLDER = "/root/testdata/sf0.01"
LABELS = "doc_id bigint, quality int, toxic int"


def held_out_rows(spark, query, label):
    from pyspark.sql import functions as F

    scored = query(spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", F.col(label).alias("label"))
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert all(fold(r.doc_id) == 0 for r in rows)
    return rows


def auc(rows):
    ones, zeros = ([r.score for r in rows if r.label == k] for k in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_quality_of_held_out_documents(spark):
    rows = held_out_rows(spark, quality_mil.op7_quality_classifier, "quality")
    assert auc(rows) > 0.95 and all(r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity_of_held_out_documents(spark):
    rows = held_out_rows(spark, toxicity.op3_toxicity, "toxic")
    assert auc(rows) > 0.7 and all(r.predicted == (r.score >= 0.5) for r in rows)


def test_language_of_held_out_documents(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()}
    rows = langid.op4_language_id(spark, FOLDER).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(docs) and {r.doc_id for r in held} == {d for d in docs if fold(d) == 0}
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def planted(n=160):
    """Toxic texts have a word of a family that ordinary ones do not have."""
    rng = random.Random(6)
    syllables = "ka mo te ri su no la pe vi do".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(20, 80))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = "zug" + word()
        docs.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_planted_toxic_words_are_found(spark):
    docs, labels = planted()
    got = toxicity.score(frame(spark, docs, extra=True), spark.createDataFrame(labels, LABELS), ["doc_id"]).collect()
    toxic = {d: t for d, _, t in labels}
    held = [r for r in got if fold(r.doc_id) == 0]
    assert sum((r.score >= 0.5) == toxic[r.doc_id] for r in held) / len(held) > 0.9


def test_kneser_ney_by_the_definition():
    """Ratios against plain dictionaries on a small alphabet."""
    rng = random.Random(9)
    texts = [["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 60))) for _ in range(12)] for _ in range(2)]
    count = [{}, {}]
    for k in (0, 1):
        _, grams = toxicity.ngrams(texts[k])
        for g in grams.tolist():
            count[k][g] = count[k].get(g, 0) + 1
    grams = np.array(sorted({*count[0], *count[1]}), dtype=np.int64)
    by_context, values = toxicity.ratios(grams, np.array([[c.get(int(g), 0) for g in grams] for c in count], dtype=float))
    split = lambda g, n: tuple((g >> (5 * (n - 1 - i))) & 31 for i in range(n))
    seen = {split(int(g), toxicity.ORDER) for g in grams}
    levels = []
    for n in range(toxicity.ORDER - 1, 0, -1):
        shorter, before = {}, {}
        for g in seen:
            before.setdefault(g[1:], set()).add(g[0])
        shorter = {g: len(b) for g, b in before.items()}
        levels.append(shorter)
        seen = set(shorter)

    def discount(counts):
        one, two = sum(c == 1 for c in counts), sum(c == 2 for c in counts)
        return one / (one + 2 * two) if one else 0.5

    def shared(g):
        if not g:
            return 1 / 32
        c = levels[toxicity.ORDER - 1 - len(g)]
        d = discount(c.values())
        row = {x: n for x, n in c.items() if x[:-1] == g[:-1]}
        total = sum(row.values())
        return (max(row.get(g, 0) - d, 0) + d * len(row) * shared(g[1:])) / total if total else shared(g[1:])

    def p(k, g):
        plain = {split(x, toxicity.ORDER): n for x, n in count[k].items()}
        d = discount(plain.values())
        row = {x: n for x, n in plain.items() if x[:-1] == g[:-1]}
        total = sum(row.values())
        return (max(row.get(g, 0) - d, 0) + d * len(row) * shared(g[1:])) / total if total else shared(g[1:])

    for g, v in list(zip(grams.tolist(), values))[::7]:
        x = split(g, toxicity.ORDER)
        assert math.isclose(math.log(p(1, x) / p(0, x)), v, rel_tol=1e-4, abs_tol=1e-4)
    known = {x >> 5 for x in grams.tolist()}
    for context in list(known)[::5]:
        unseen = next(s for s in range(32) if (context << 5 | s) not in set(grams.tolist()))
        x = split(context << 5 | unseen, toxicity.ORDER)
        assert math.isclose(math.log(p(1, x) / p(0, x)), by_context[context], rel_tol=1e-4, abs_tol=1e-4)


def test_gradients_of_the_attention_model():
    rng = np.random.default_rng(2)
    count = np.array([3, 1, 2])
    x, y = rng.normal(size=(6, quality_mil.INPUT)), np.array([1.0, 0.0, 1.0])
    m = quality_mil.Model(mean=np.zeros(quality_mil.INPUT), scale=np.ones(quality_mil.INPUT))
    h, g = quality_mil.HIDDEN, quality_mil.GATE
    m.weights = {k: rng.normal(0, 0.3, s) for k, s in {"w": (quality_mil.INPUT, h), "b": h, "v": (h, g), "u": (h, g), "a": g, "z": h}.items()} | {"c": np.zeros(())}
    grads = m.gradients(x, count, y)

    def loss():
        out = m.forward(x, count)["out"]
        return (np.log1p(np.exp(out)) - y * out).mean()

    for name in grads:
        flat, at = m.weights[name].reshape(-1), 0 if name == "c" else 3
        keep = flat[at]
        ends = []
        for d in (1e-5, -1e-5):
            flat[at] = keep + d
            ends.append(loss())
        flat[at] = keep
        assert math.isclose((ends[0] - ends[1]) / 2e-5, grads[name].reshape(-1)[at], rel_tol=1e-3, abs_tol=1e-7)


def test_kernel_by_the_definition():
    texts = ["the cat", "A cat, the", "zz", "häuser 12 sind", ""]
    x, has = langid.presence(texts)
    assert has.tolist() == [True, True, True, True, False]
    for i, t in enumerate(texts):
        alone, _ = langid.presence([t])
        assert (alone[0] == x[i]).all()
    marks = x[:3].astype(np.float32)
    m = langid.Model(["a"], (marks / np.sqrt(marks.sum(axis=1, keepdims=True))).T, np.ones((3, 1)), 1.0)
    k = m.kernel(x)
    for i in range(4):
        for j in range(3):
            assert math.isclose(k[i, j], (x[i] & x[j]).sum() / math.sqrt(x[i].sum() * x[j].sum()), rel_tol=1e-5)


@pytest.mark.parametrize("rows", [awkward(), [], [r for r in awkward() if r[0] is None]])
def test_awkward_rows(spark, rows):
    docs = frame(spark, rows, extra=True)
    labels = spark.createDataFrame([(r[0], i % 2, i % 3 == 0) for i, r in enumerate(rows)] + [(0, None, None), (7, 0, True), (None, 1, False)], "doc_id bigint, quality int, toxic boolean")
    ids = sorted((r[0] for r in rows), key=repr)
    for out in (
        quality_mil.score(docs, quality_mil.train(docs, labels), ["doc_id"]),
        toxicity.score(docs, labels, ["doc_id"]),
        langid.predict(docs, langid.train(docs), ["doc_id"]),
    ):
        got = out.collect()
        assert sorted((r.doc_id for r in got), key=repr) == ids
        assert all(0 <= r.score <= 1 for r in got)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert not rows or len(rows) < 5 or und == {100, 101, 102, 105, 107}


def test_without_labels(spark):
    docs, none = frame(spark), spark.createDataFrame([], LABELS)
    assert {r.score for r in quality_mil.score(docs, quality_mil.train(docs, none), ["doc_id"]).collect()} == {0.5}
    assert {r.score for r in toxicity.score(docs, none, ["doc_id"]).collect()} == {0.5}


def test_labels_of_held_out_documents_have_no_say(spark):
    docs, labels = planted(80)
    other = [(d, q, 1 - t if fold(d) == 0 else t) for d, q, t in labels]
    scores = [bag(toxicity.score(frame(spark, docs), spark.createDataFrame(x, LABELS), ["doc_id"]), "doc_id", "score") for x in (labels, other)]
    assert scores[0] == scores[1]
    langs = [[(*r[:2], "xx" if fold(r[0]) == 0 else ("aa", "bb")[r[0] % 2], *r[3:]) for r in docs], [(*r[:2], ("aa", "bb")[r[0] % 2], *r[3:]) for r in docs]]
    models = [langid.train(spark.createDataFrame(x, DOCS)) for x in langs]
    assert models[0].languages == models[1].languages == ["aa", "bb"] and np.array_equal(models[0].weights, models[1].weights)


def test_toxic_expressions_of_ordinary_words(spark):
    """Toxic texts have two ordinary words side by side; ordinary texts have both, apart. Words are in Cyrillic."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("абвгдежзик") for _ in range(5)) for _ in range(60)]
    docs, labels = [], []
    for i in range(300):
        w = [rng.choice(vocabulary) for _ in range(40)]
        toxic = i % 2
        w[5:7] = ["луна", "река"] if toxic else ["река", "луна"]
        docs.append((i, " ".join(w), "ru", "s", 1))
        labels.append((i, 1, toxic))
    got = toxicity.score(frame(spark, docs), spark.createDataFrame(labels, LABELS), ["doc_id"]).collect()
    held = [r for r in got if fold(r.doc_id) == 0]
    assert sum((r.score >= 0.5) == r.doc_id % 2 for r in held) / len(held) > 0.95


def test_language_score_does_not_sink_with_length(spark):
    rows = [(r.doc_id, r.text, r.lang, "s", 1) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect() if r.doc_id is not None and r.text and r.lang]
    model = langid.train(frame(spark, rows))
    docs = []
    for k, lang in enumerate(model.languages):
        joined = " ".join(t for d, t, x, *_ in rows if x == lang and fold(d) == 0)
        long = (joined + "\n") * (1 + 1_000_000 // len(joined))
        # a wide vocabulary: the text's own runs of letters, shuffled
        pieces = [joined[i : i + 7] for i in range(0, len(joined) - 7, 7)]
        docs += [(10 * k, joined[:2000], lang, "s", 1), (10 * k + 1, long, lang, "s", 1)]
        random.Random(k).shuffle(pieces)
        docs.append((10 * k + 2, "".join(pieces * (1 + 1_000_000 // (7 * len(pieces))))[:1_000_000], lang, "s", 1))
    got = {r.doc_id: r for r in langid.predict(frame(spark, docs), model, ["doc_id"]).collect()}
    for k, lang in enumerate(model.languages):
        assert {got[10 * k + i].lang_pred for i in (0, 1, 2)} == {lang}
        assert abs(got[10 * k + 1].score - got[10 * k].score) < 0.1 and got[10 * k + 2].score > 0.8


def test_every_learnable_label_is_counted(spark):
    docs, labels = planted(100)
    pool = toxicity.labelled(frame(spark, docs).where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"), spark.createDataFrame(labels, LABELS), "toxic")
    ends = toxicity.counted(pool, 80).where(f"second = {toxicity.END} AND first <> {toxicity.SYMBOLS}")
    got = ends.selectExpr("sum(ordinary)", "sum(toxic)", "sum(rest_ordinary) + sum(rest_toxic)").first()
    learnable = [t for d, _, t in labels if fold(d) != 0]
    assert tuple(got[:2]) == (learnable.count(0), learnable.count(1)) and 0 < got[2] < len(learnable)


def brute_words(labelled, scored):
    """word_mean, word_top and stem_plus of each text by plain dictionaries; labelled: (text, label)."""
    import re
    from collections import Counter

    toks = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower()) if w]
    stem = lambda w: w[: toxicity.STEM] if w != "</s>" else w
    pairs, words = [Counter(), Counter()], [Counter(), Counter()]
    for text, k in labelled:
        ws = toks(text)
        if not ws:
            continue
        pairs[k].update(zip(ws, ws[1:]))
        words[k].update([*ws, "</s>"])
    size = [sum(x.values()) for x in words]
    telling = lambda x, u: x[1][u] >= toxicity.LEAST and x[1][u] * size[0] >= toxicity.RATE * x[0][u] * size[1]
    kept = {p for p in pairs[1] if telling(pairs, p)}
    vocabulary = {w for w in words[1] if telling(words, w)} | {w for p in kept for w in p}

    def discount(values):
        values = list(values)
        one, two = values.count(1), values.count(2)
        return one / (one + 2 * two) if one else 0.5

    d = [discount(pairs[0][p] for p in kept), discount(pairs[1].values())]
    e = [discount(words[0][w] for w in vocabulary), discount(words[1].values())]
    members, s = {}, [Counter(), Counter()]
    for k in (0, 1):
        for w, n in words[k].items():
            s[k][stem(w)] += n
            members.setdefault(stem(w), set()).update([w] if w in vocabulary else [])
    g = [discount(x.values()) for x in s]
    total, all_types = [sum(x.values()) for x in s], sum(len(ws) + 1 for ws in members.values())
    back = [g[k] * len(s[k]) / total[k] for k in (0, 1)]
    unknown = math.log(back[1] / back[0])
    p_stem = lambda k, x: max(s[k][x] - g[k], 0) / total[k] + back[k] * (len(members[x]) + 1) / (all_types + 1)
    inner = lambda k, x: 1 - sum(max(words[k][w] - e[k], 0) for w in members[x]) / s[k][x] if s[k][x] else 1.0

    def p_word(k, w):
        x = stem(w)
        own = max(words[k][w] - e[k], 0) / s[k][x] if s[k][x] else 0
        return p_stem(k, x) * (own + inner(k, x) / (len(members[x]) + 1))

    def ratio(w):
        if w in vocabulary:
            return math.log(p_word(1, w) / p_word(0, w))
        x = stem(w)
        return math.log(p_stem(1, x) / p_stem(0, x)) + math.log(inner(1, x) / inner(0, x)) if x in members else unknown

    def context(k, v):
        n = words[k][v]
        held = sum(max(pairs[k][p] - d[k], 0) for p in kept if p[0] == v)
        return (1 - held / n if n else 1.0), n

    def joint(v, w):
        """Ratio of w after v."""
        b = [context(k, v) if v in vocabulary else (1.0, 0) for k in (0, 1)]
        if (v, w) in kept:
            p = [(max(pairs[k][v, w] - d[k], 0) / b[k][1] if b[k][1] else 0) + b[k][0] * p_word(k, w) for k in (0, 1)]
            return math.log(p[1] / p[0])
        return math.log(b[1][0] / b[0][0]) + ratio(w)

    out = []
    for text in scored:
        ws = toks(text)
        if not ws:
            out.append((0.0, 0.0, 0.0))
            continue
        chain = list(zip(["<s>", *ws], [*ws, "</s>"]))
        mean = sum(joint(*p) for p in chain) / len(chain)
        tops = [ratio(w) for _, w in chain if w in vocabulary] or [0.0]
        tops += [joint(v, w) + ratio(v) for v, w in chain if (v, w) in kept]
        plus = sum(max(math.log(p_stem(1, stem(w)) / p_stem(0, stem(w))) - toxicity.MARGIN, 0) for _, w in chain if stem(w) in members)
        out.append((mean, max(tops), plus / len(chain)))
    return out


@pytest.mark.parametrize("hot", [1 << 18, 20])
def test_word_measures_by_the_definition(spark, monkeypatch, hot):
    """All measures of words against plain dictionaries, with the values looked up and with most of them joined."""
    monkeypatch.setattr(toxicity, "HOT", hot)
    docs, labels = planted(60)
    docs += [(500, None, "en", "s", 1), (501, "ka mo ka mo unheard words", "en", "s", 1), (502, docs[0][1], "en", "s", 1)]
    label = {d: t for d, _, t in labels}
    known = [(t, label[d]) for d, t, *_ in docs if d in label and fold(d) != 0]
    pool = toxicity.labelled(frame(spark, [r for r in docs if fold(r[0]) != 0]), spark.createDataFrame(labels, LABELS), "toxic")
    found = toxicity.expressions(pool.where("label = 1"))
    counts, columns = toxicity.materialize(toxicity.counted(pool, pool.count(), found), "counts"), ["ordinary", "toxic"]
    got = toxicity.measured(frame(spark, docs), toxicity.symbol_model(counts, columns, toxicity.LATIN), *toxicity.word_model(counts, columns, found.discounts), ["doc_id"])
    got = {r.doc_id: (r.word_mean, r.word_top, r.stem_plus) for r in got.collect()}
    for (d, *_), want in zip(docs, brute_words(known, [r[1] for r in docs])):
        assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6) for a, b in zip(got[d], want)), (d, got[d], want)


def test_length_is_no_measure_of_toxicity(spark):
    """A text repeated until it is longer than a chunk keeps its score."""
    docs, labels = planted()
    some = [r for r in docs if r[0] % 40 == 0]
    long = [(1000 + r[0], (r[1] + "\n") * (1 + 300_000 // len(r[1])), *r[2:]) for r in some]
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, docs + long), spark.createDataFrame(labels, LABELS), ["doc_id"]).collect()}
    assert all((got[r[0]] >= 0.5) == (got[1000 + r[0]] >= 0.5) for r in some)


def test_letters_of_any_script_have_symbols(spark):
    texts = spark.createDataFrame([("привет мир " * 5,), ("häß 0",), (None,)], "text string")
    alphabet = toxicity.learned_alphabet(texts)
    assert set("приветмhäß0") <= set(alphabet)
    _, a = toxicity.ngrams(["ä"], alphabet)
    _, b = toxicity.ngrams(["ж"], alphabet)
    assert a[0] != b[0]


def test_bags_are_bounded(spark):
    """A long document is learned from in BAG passages over its whole length, and one text of an id that repeats."""
    words = [f"w{i % 97}" for i in range(quality_mil.PASSAGE * 500)]
    rows = [(i, " ".join(words) if i == 1 else f"text {i} of few words", "en", "s", 1) for i in range(1, 30)]
    rows += [(2, f"another text {k}", "en", "s", 1) for k in range(20)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(words)])], ["label", "text"])
    (out,) = quality_mil._bags(iter([batch]))
    bag = np.frombuffer(out.column("bag")[0].as_py(), dtype=np.float16).reshape(-1, quality_mil.INPUT)
    whole, count = quality_mil.passages([" ".join(words)])
    assert count[0] == 500 and len(bag) == quality_mil.BAG and np.array_equal(bag[-1], whole[(quality_mil.BAG - 1) * 500 // quality_mil.BAG].astype(np.float16))
    seen = []
    fit = quality_mil.fit
    try:
        quality_mil.fit = lambda bags, y: seen.append((len(bags), y.tolist())) or fit(bags, y)
        labels = [(i, i % 2, 0) for i in range(1, 30)]
        docs = frame(spark, rows)
        scores = quality_mil.score(docs, quality_mil.train(docs, spark.createDataFrame(labels, LABELS)), ["doc_id"]).collect()
    finally:
        quality_mil.fit = fit
    learnable = [i for i, _, _ in labels if fold(i) != 0]
    assert seen[0][0] == len(learnable) and len(scores) == len(rows)


def test_texts_longer_than_a_chunk(spark):
    """Operators 4 and 7 on a text of more than a chunk: as many rows, the language and nearly the score of its parts."""
    rows = [(r.doc_id, r.text, r.lang, "s", 1) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text and r.lang]
    part = next(r for r in rows if r[2] == "de" and len(r[1]) > 2000)
    long = (10_000_001, (part[1] + "\n") * (1 + 300_000 // len(part[1])), "de", "s", 1)
    docs = frame(spark, [*rows, long])
    got = {r.doc_id: r for r in langid.predict(docs, langid.train(frame(spark, rows)), ["doc_id"]).collect()}
    assert got[long[0]].lang_pred == "de" and abs(got[long[0]].score - got[part[0]].score) < 0.1
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality_mil.train(frame(spark, rows), labels)
    got = {r.doc_id: r.score for r in quality_mil.score(docs, model, ["doc_id"]).collect()}
    assert len(got) == len(rows) + 1 and abs(got[long[0]] - got[part[0]]) < 0.2


def test_calibration_sees_every_learnable_label(spark, monkeypatch):
    """Each once, under counts of the other half."""
    docs, labels = planted(100)
    seen, calibrate = [], toxicity.calibrate
    monkeypatch.setattr(toxicity, "calibrate", lambda rows, *a: (seen.append(rows.groupBy("label").count().collect()), calibrate(rows, *a))[1])
    toxicity.score(frame(spark, docs), spark.createDataFrame(labels, LABELS), ["doc_id"]).collect()
    learnable = [t for d, _, t in labels if fold(d) != 0]
    assert {tuple(r) for r in seen[0]} == {(k, learnable.count(k)) for k in (0, 1)}


def test_weights_by_plain_newton_steps(spark):
    """The same as those of all rows in one array."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, len(toxicity.MEASURES))) * 3 + 1
    y = (x @ np.arange(1, x.shape[1] + 1) + rng.normal(size=400) * 20 > 20).astype(float)
    rows = spark.createDataFrame([(int(b), *map(float, a)) for a, b in zip(x, y)], "label int, " + ", ".join(f"{m} double" for m in toxicity.MEASURES)).repartition(3)
    got = toxicity.calibrate(rows, x.mean(axis=0), x.std(axis=0))
    z, w = np.c_[(x - x.mean(axis=0)) / x.std(axis=0), np.ones(400)], np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w)), z.T @ (p - y) + 0.1 * w)
    plain = w[:-1] / x.std(axis=0)
    assert np.allclose(got, np.r_[plain, w[-1] - plain @ x.mean(axis=0)], rtol=1e-4)
