"""Operators 5, 6, 8, 9 and 10 by their definitions, and on awkward rows."""

import collections
import hashlib
import random
import re

import pytest
from data import awkward, bag, frame, words
from oracle import database, same

from reprise.llm import decontaminate, mixing, quality_rules, registry, token_counts, warc
from reprise.llm.common import Words

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_by_its_sql(spark, name):
    same(registry.queries()[name](spark, FOLDER), database(FOLDER), registry.oracle_sql()[name])


# 5


def best_by_search(word, v):
    """Fewest pieces of the best sum, over all segmentations."""
    from functools import cache

    @cache
    def best(i):
        if i == len(word):
            return 0.0, 0
        size = len(word[i].encode())
        found = [(size * v.byte + best(i + 1)[0], best(i + 1)[1] - size)]
        for j in range(i + 1, min(len(word), i + v.longest) + 1):
            if word[i:j] in v.pieces:
                found.append((v.pieces[word[i:j]] + best(j)[0], best(j)[1] - 1))
        return max(found, key=lambda x: (round(x[0], 9), x[1]))

    return -best(0)[1]


def count_pieces(word, v):
    """Pieces of the best segmentation, a character at a time."""
    best = [(0.0, 0)]
    for end, c in enumerate(word, 1):
        size = len(c.encode())
        found = (best[end - 1][0] + size * v.byte, best[end - 1][1] - size)
        for start in range(max(0, end - v.longest), end):
            if word[start:end] in v.pieces:
                found = max(found, (best[start][0] + v.pieces[word[start:end]], best[start][1] - 1))
        best.append(found)
    return -best[-1][1]


def test_long_pre_tokens_by_search():
    """Words beyond and around the longest that share nodes, whole texts without a blank, and more than a chunk of them."""
    import time

    import numpy as np

    v, rng = token_counts.vocabulary(), random.Random(8)
    texts = ["x" * n for n in (255, 256, 257, 400)] + ["".join(rng.choice("日本語のテキスト") for _ in range(700)), "".join(rng.choice("abcdethising0123") for _ in range(3000))]
    for text in texts:
        assert token_counts.word_counts(Words([text]), v).tolist() == [count_pieces(token_counts.MARK + text, v)]
    for text in texts[:4]:
        w = Words([text])
        assert token_counts.path_count(w.codes[: len(text)], v) == token_counts.trie_counts(w.codes, w.starts, w.ends, v)[0]
    long = np.array([rng.randrange(97, 123) for _ in range(300_000)], dtype=np.uint32)
    start = time.time()
    assert token_counts.path_count(long, v) == count_pieces(token_counts.MARK + "".join(map(chr, long)), v)
    assert time.time() - start < 60


def test_a_missing_vocabulary_is_an_error():
    with pytest.raises(FileNotFoundError, match="no vocabulary file"):
        token_counts.vocabulary("/nowhere/piece.model")


def test_trie_counts_by_search():
    v = token_counts.vocabulary()
    rng = random.Random(3)
    texts = ["the quick brown fox jumped", "internationalization anti- a aa aaa ß \U0001f600 日本語", "x" * 300 + " tail"]
    texts += [" ".join("".join(rng.choice("abcdethis ing") for _ in range(12)) for _ in range(20))]
    for t in texts:
        w = Words([t])
        got = token_counts.word_counts(w, v)
        for word, n in zip(words(t), got.tolist(), strict=True):
            assert n == count_pieces(token_counts.MARK + word, v)
            if len(word) < 60:
                assert n == best_by_search(token_counts.MARK + word, v), word


def test_token_counts_of_awkward_rows(spark):
    v = token_counts.vocabulary()
    rows = awkward()
    got = bag(token_counts.count_tokens(frame(spark, rows, extra=True).drop("n_words"), ["doc_id"]), "doc_id", "n_words", "n_tokens")
    known = {}
    count = lambda w: known.setdefault(w, count_pieces(token_counts.MARK + w, v))
    assert got == sorted(((r[0], len(words(r[1])), sum(map(count, words(r[1])))) for r in rows), key=repr)
    assert token_counts.count_tokens(frame(spark, []), ["doc_id"]).count() == 0


# 6


def brute_counts(text):
    text = text or ""
    w = words(text)
    three = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_base_counts_by_the_definition():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab #|\n\t<é") for _ in range(rng.randrange(120))) for _ in range(200)] + [r[1] or "" for r in awkward()]
    found = quality_rules.counts(texts)
    got = list(zip(*(found[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
    assert got == [brute_counts(t) for t in texts]


def test_rules_on_awkward_rows(spark):
    rows = awkward()
    out = quality_rules.apply_rules(frame(spark, rows, extra=True)).collect()
    assert len(out) == len(rows)
    assert sorted(((r.doc_id, r.n_words) for r in out), key=repr) == sorted(((r[0], len(words(r[1]))) for r in rows), key=repr)
    assert not any(r.kept and r.base_failed for r in out)
    assert quality_rules.apply_rules(frame(spark, [])).count() == 0


def test_outliers_of_a_group_go(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows = [(i, prose(80), "en", "a", 1) for i in range(250)] + [(1000, prose(80).replace(" w1", " $$$%%%w1"), "en", "a", 1)]
    kept = {r.doc_id: r.kept for r in quality_rules.apply_rules(frame(spark, rows)).collect()}
    assert not kept[1000] and all(kept[i] for i in range(250))


# 8


def brute_mix(rows, weight_of):
    size = [len(words(r[1])) for r in rows]
    per = collections.Counter()
    for r, n in zip(rows, size, strict=True):
        per[r[3]] += n
    order = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, target = set(), {}
    while True:  # reshare the excess until no source is above its cap
        left = sum(per.values()) - sum(3 * per[s] for s in capped)
        weight = sum(w[s] for s in order if s not in capped)
        target = {s: 3 * per[s] if s in capped else left * w[s] / weight for s in order}
        above = {s for s in order if s not in capped and target[s] > 3 * per[s]}
        if not above:
            return size, per, target
        capped |= above


def test_mix_by_the_definition(spark):
    rows = awkward() + [(500 + i, "q " * (i % 7), "en", s, 1) for i, s in enumerate(["tiny", "z", "é", None, "b"] * 8)]
    out = mixing.mix(frame(spark, rows, extra=True)).collect()
    size, per, target = brute_mix(rows, {})
    assert sorted(((r.doc_id, r["size"], r.source_size) for r in out), key=repr) == sorted(((x[0], n, per[x[3]]) for x, n in zip(rows, size)), key=repr)
    taken = collections.Counter()
    for r in out:
        assert abs(r.target - target[r.source]) < 1e-6 and r.taken <= 3 * r["size"]
        assert r["size"] == 0 or r.taken % r["size"] == 0
        taken[r.source] += r.taken
    for s, goal in target.items():
        largest = max(n for x, n in zip(rows, size) if x[3] == s)
        assert abs(taken[s] - goal) <= largest / 2 + 1e-6
    again = mixing.mix(frame(spark, list(reversed(rows))).repartition(7)).collect()
    key = lambda rs: sorted(((r.doc_id, r["size"], r.taken) for r in rs), key=repr)
    assert key(out) == key(again)


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 0, "b": 10, "c": 3, "d": 0, "e": 1, "": 7, None: 40}, {f"src{i}": 50 + i for i in range(20)}])
def test_sources_that_end_below_their_caps(spark, sizes):
    rows = [(i, "w " * n, "en", s, 1) for i, (s, n) in enumerate(sizes.items())]
    _, per, target = brute_mix(rows, {})
    got = {r.source: r for r in mixing.targets(spark.createDataFrame(list(per.items()), "source string, source_size bigint")).collect()}
    assert {s: r.source_size for s, r in got.items()} == per
    assert all(abs(got[s].target - goal) < 1e-6 for s, goal in target.items())
    assert abs(sum(r.target for r in got.values()) - sum(per.values())) < 1e-6
    assert all(r.taken >= 0 for r in mixing.mix(frame(spark, rows)).collect())


def test_weights_favour_good_documents(spark):
    rows = [(i, "w " * 10, "en", "ab"[i % 2], 1) for i in range(2000)]
    rows += [(9000 + i, "w " * 10, "en", "b", 1) for i in range(100)]
    weights = spark.createDataFrame([(i, 4.0 if i % 4 == 1 else 0.25) for i in range(2000)], "doc_id bigint, weight double")
    out = {r.doc_id: r.taken for r in mixing.mix(frame(spark, rows), weights).collect()}
    good, bad = (sum(out[i] for i in range(k, 2000, 4)) for k in (1, 3))
    assert good > 2 * bad


def test_mix_of_nothing(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [(r["size"], r.target, r.taken) for r in mixing.mix(frame(spark, [(1, None, None, None, None)])).collect()] == [(0, 0.0, 0)]


# 9

PAGES = "page_id bigint, url string, html string"


def brute_warc(rows):
    groups = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            groups.setdefault(data, []).append(page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        ids = [p for p in groups.get(data, []) if p is not None]
        top = max(ids) if ids and len(groups[data]) > 1 else None
        revisit = top is not None and page != top
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def pages():
    record = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:reprise:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    big = "<p>é\n\r\n</p>" * 200
    rows = [(i, f"http://a/{i}", f"<html>{i}\r\n\r\n{'x' * i}</html>") for i in range(30)]
    rows += [(100, "u", record), (101, "u", record * 50), (102, "u", "a" + record + "b"), (103, None, "WARC/1.0\r\n"), (104, "u v\r\nX: y", "\r\n\r\nWARC/1.0\r\nContent-Length: x\r\n\r\n")]
    rows += [(200, "u", big), (201, "u", big), (202, "u", big), (202, "u", big), (None, "u", big), (203, "u", None), (204, "u", ""), (205, "u", "small"), (206, "u", "small"), (None, None, None)]
    return rows + [(300, "u", big + record * 3), (301, "u", big + record * 3)]


def test_archives_give_the_pages_back(spark, tmp_path):
    rows = pages()
    spark.createDataFrame(rows, PAGES).repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    assert bag(warc.op9_warc(spark, str(tmp_path)), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == brute_warc(rows)


def test_archives_of_long_payloads_and_clashing_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(1, "u", "<p>long</p>" * 40_000), (2, "u", "<p>long</p>" * 40_000), (3, "u", "short"), (3, "u", "short")]
    df = spark.createDataFrame(rows, PAGES)
    for name in ("digest", "bytes", "first", "of", "copies", "value", "file", "off", "row"):
        df = df.withColumn(name, F.lit("clash"))
    df.write.parquet(str(tmp_path / "pages.parquet"))
    assert bag(warc.op9_warc(spark, str(tmp_path)), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == brute_warc(rows)


def test_long_texts_are_counted_whole(spark):
    """Operators 5, 6, 8 and 10 on a text longer than a chunk, beside short ones."""
    v = token_counts.vocabulary()
    rng = random.Random(12)
    vocabulary = [f"word{i}" for i in range(500)]
    text = " ".join(rng.choice(vocabulary) for _ in range(60_000))
    item = " ".join(f"item{i}" for i in range(20))
    rows = [(1, text, "en", "a", 1), (2, text + " " + item, "en", "a", 1), (3, "short text", "en", "b", 1)]
    assert len(text) > 300_000
    docs = frame(spark, rows, extra=True).drop("n_words")
    known = {w: count_pieces(token_counts.MARK + w, v) for r in rows for w in words(r[1])}
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.count_tokens(docs, ["doc_id"]).collect()}
    assert got == {r[0]: (len(words(r[1])), sum(known[w] for w in words(r[1]))) for r in rows}
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.apply_rules(docs).collect()}
    assert got == {r[0]: brute_counts(r[1]) for r in rows}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(docs, spark.createDataFrame([(7, item)], ITEMS), ["doc_id"]).collect()}
    assert got == {1: (60_000, 0, 0), 2: (60_020, 20, 1), 3: (2, 0, 0)}
    assert {r.doc_id: r["size"] for r in mixing.mix(frame(spark, rows), spark.createDataFrame([], "doc_id bigint, weight double")).collect()} == {1: 60_000, 2: 60_020, 3: 2}


def test_archives_in_small_splits(spark, tmp_path):
    rows = pages()
    spark.createDataFrame(rows, PAGES).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        assert bag(warc.op9_warc(spark, str(tmp_path)), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == brute_warc(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def test_no_pages_and_broken_archives(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op9_warc(spark, str(tmp_path)).count() == 0
    good = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    for n, (text, count) in enumerate([("junk" + good, 0), (good + good, 2), (good + "WARC/1.0\r\nContent-Length: 99\r\n\r\nab", 1), ("", 0)]):
        folder = tmp_path / f"w{n}"
        folder.mkdir()
        (folder / "a.warc").write_bytes(text.encode())
        assert warc.read_archives(spark, str(folder)).count() == count


# 10

ITEMS = "item_id bigint, text string"
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_hits(docs, items):
    tokens = lambda t: PLAIN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = []
    for i, t in items:
        w = tokens(t)
        n = min(13, len(w))
        wins.append((i, n, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()))
    out = []
    for d in docs:
        w = tokens(d[1])
        hit, ids = set(), set()
        for i, n, ws in wins:
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in ws:
                    hit |= set(range(k, k + n))
                    ids |= {str(i)} - {"None"}
        out.append((d[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_contamination_by_all_windows(spark):
    rng = random.Random(7)
    vocabulary = ["Alpha", "beta", "GAMMA", "d3", "é", "zeta"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(n)) for i, n in enumerate([1, 2, 3, 12, 13, 14, 20, 40, 40])] + [(50, None), (51, "..."), (None, prose(15)), (52, "beta"), (8, prose(9))]
    docs = []
    for i in range(80):
        text = prose(rng.randrange(0, 60)) if i % 2 else " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(60)))
        if i % 3 == 0:
            source = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(source) + 1)
            text += "\n" + "-".join(source[a : a + rng.randrange(1, 30)]).upper() + "! " + text
        docs.append((i, text, "en", "s", 1))
    docs += awkward()
    got = decontaminate.contamination(frame(spark, docs, extra=True), spark.createDataFrame(items, ITEMS), ["doc_id"])
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert bag(got, *columns) == brute_hits(docs, items)


@pytest.mark.parametrize("seed", range(3))
def test_a_span_of_thirteen_words_is_always_found(spark, seed):
    rng = random.Random(seed)
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for i in range(10)]
    docs = []
    for i, text in items:
        for k in range(28):
            around = [" ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(9))) for _ in range(2)]
            docs.append((100 * i + k, f"{around[0]} {' '.join(text.split()[k : k + 13])} {around[1]}", "en", "s", 1))
    got = decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, ITEMS), ["doc_id"]).collect()
    assert all(r.n_hit == 13 and r["items"] == [str(r.doc_id // 100)] for r in got)


def test_no_items_or_no_documents(spark):
    none = spark.createDataFrame([], ITEMS)
    assert {(r.n_hit, r.contaminated) for r in decontaminate.contamination(frame(spark), none, ["doc_id"]).collect()} == {(0, False)}
    assert decontaminate.contamination(frame(spark, []), spark.createDataFrame([(1, "a b")], ITEMS), ["doc_id"]).count() == 0


def test_every_group_has_its_own_thresholds(spark):
    """A group's sketch counts at every size: the more of its documents there are, the further its thresholds are from its language's."""
    from pyspark.sql import functions as F

    kinds = "doc_id bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in quality_rules.COUNTS)
    text = lambda i, size: " ".join(f"{k:0{size + (i + k) % 3}d}" for k in range(60))
    base = [(i, text(i, 5), "en", "long ago", 1) for i in range(200)]
    far = []
    for n in (2, 30, 150):
        rows = base + [(1000 + i, text(i, 9), "en", "other", 1) for i in range(n)]
        measured = frame(spark, rows).select("doc_id", "lang", "source", "text").mapInArrow(quality_rules._measure, kinds)
        got = {r.source0: (r.low_word_length, r.high_word_length) for r in quality_rules.thresholds(measured).collect()}
        assert set(got) == {"long ago", "other"}
        far.append(got["other"] != got["long ago"])
        low, high = got["other"]
    assert far == [False, True, True] and low > 6 and got["long ago"][1] < high
