"""Clones against a plain suffix sort, and kept up to date against a rebuild."""

import random

import pytest
from pyspark.sql import functions as F

from reprise.operators import incremental, suffix

SCHEMA = "uri string, frag_id int, toks array<string>"


def brute(fragments, t):
    """(uri, frag, off) -> size, and the set of classes, by the definition: sort all suffixes, measure the
    common prefix of neighbours, skip matches that lie in the one before, and join the rest."""
    places = sorted(((toks[i:], u, f, i) for u, f, toks in fragments for i in range(len(toks))), key=lambda p: (p[0], p[1], p[2], p[3]))
    lcp = {}
    for a, b in zip(places, places[1:]):
        n = 0
        while n < min(len(a[0]), len(b[0])) and a[0][n] == b[0][n]:
            n += 1
        lcp[b[1:]] = (n, a[1:])
    size, parent = {}, {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for (u, f, i), (n, before) in lcp.items():
        if n < t or lcp.get((u, f, i - 1), (0, None))[0] > n and i > 0:
            continue
        for x in ((u, f, i), before):
            size[x] = max(size.get(x, 0), n - 1)
        parent[find((u, f, i))] = find(before)
    classes = {}
    for x in size:
        classes.setdefault(find(x), set()).add(x)
    return size, {frozenset(c) for c in classes.values()}


def found(df):
    size, classes = {}, {}
    for r in df.collect():
        size[r.uri, r.frag_id, r.off] = r.clone_size
        classes.setdefault(r.class_id, set()).add((r.uri, r.frag_id, r.off))
    return size, {frozenset(c) for c in classes.values()}


def corpus(rng, letters="ab"):
    return [(f"u{u}", f, [rng.choice(letters) for _ in range(rng.randrange(0, 14))]) for u in range(rng.randrange(1, 4)) for f in range(rng.randrange(1, 3))]


@pytest.mark.parametrize("seed", range(6))
def test_clones_of_random_corpora(spark, seed):
    rng = random.Random(seed)
    t = rng.choice([1, 2, 3, 4])
    rows = corpus(rng, "ab" if seed % 2 else "abc")
    assert found(suffix.clones(spark.createDataFrame(rows, SCHEMA), t)) == brute(rows, t)


def test_pruning_changes_nothing(spark):
    rows = corpus(random.Random(77))
    df = spark.createDataFrame(rows, SCHEMA)
    key = lambda d: sorted(map(str, d.collect()))
    assert key(suffix.ranked(df, 3, prune=True)) == key(suffix.ranked(df, 3, prune=False))


def test_no_fragments(spark):
    assert suffix.clones(spark.createDataFrame([], SCHEMA), 3).collect() == []


def test_overlapping_repeat(spark):
    rows = [("u", 0, list("abababab"))]
    assert found(suffix.clones(spark.createDataFrame(rows, SCHEMA), 3)) == brute(rows, 3)


@pytest.mark.parametrize("seed", range(3))
def test_refresh_equals_rebuild(spark, seed):
    rng = random.Random(seed + 50)
    state, now = incremental.build(spark.createDataFrame(corpus(rng), SCHEMA), 3), None
    rows = [tuple(r) for r in state.fragments.collect()]
    for _ in range(2):
        uris = {f"u{rng.randrange(4)}" for _ in range(2)}
        come = [r for r in corpus(rng) if r[0] in uris]
        rows = [r for r in rows if r[0] not in uris] + come
        state = incremental.refresh(state, spark.createDataFrame([(u,) for u in uris], "uri string"), spark.createDataFrame(come, SCHEMA))
        now = found(state.clones())
        assert now == brute([(u, f, list(t)) for u, f, t in rows], 3)


def test_pairs_and_matches(spark):
    rows = [("u", 0, list("abcdx")), ("v", 0, list("abcdy")), ("w", 0, list("abcdz"))]
    nodes = suffix.clones(spark.createDataFrame(rows, SCHEMA), 4)
    assert nodes.count() == 3 and suffix.matches(nodes).count() == 6


def test_places_that_go_on_alike_are_one_row(spark):
    """Copies make a row each and not a row for each place, and places have the ranks of a plain sort."""
    same = [f"w{i}" for i in range(60)]
    rows = [("u", 0, [*same, "x"]), ("v", 0, [*same, "y"]), ("w", 0, ["z", *same[:40]])]
    df = spark.createDataFrame(rows, SCHEMA)
    chains = suffix.chained(df, 5)
    assert chains.count() == 5
    key = lambda d: sorted(map(str, d.select(*suffix.PLACE, "rk", "lcp", "prev").collect()))
    assert key(suffix.places(chains)) == key(suffix.ranked(df, 5, prune=False))


@pytest.mark.parametrize("hops", [0, 3])
def test_only_what_a_batch_can_change_is_found_anew(spark, monkeypatch, hops):
    """A print links u and v, another v and w, none x and y; a batch that takes u away can change those two, and w."""
    monkeypatch.setattr(incremental, "HOPS", hops)
    rows = [("u", 0, list("abcd")), ("v", 0, list("abcd12345")), ("w", 0, list("2345")), ("x", 0, list("pqrs")), ("y", 0, list("pqrst"))]
    state = incremental.build(spark.createDataFrame(rows, SCHEMA), 4)
    asked, clones = [], incremental.clones
    monkeypatch.setattr(incremental, "clones", lambda f, t: (asked.append({r.uri for r in f.select("uri").collect()}), clones(f, t))[1])
    state = incremental.refresh(state, spark.createDataFrame([("u",)], "uri string"), spark.createDataFrame([], SCHEMA))
    assert found(state.clones()) == brute(rows[1:], 4)
    assert asked == [{"v", "w"} if hops else {"v", "w", "x", "y"}]


@pytest.mark.parametrize("seed", range(3))
def test_long_runs_are_compared_in_rounds(spark, monkeypatch, seed):
    """Runs of many chains, copies of them, and overlapping repeats: no row has more numbers than a round compares."""
    monkeypatch.setattr(suffix, "STEPS", 2)
    rng = random.Random(seed)
    long = [rng.choice("ab") for _ in range(50)]
    rows = [("v", 0, long), ("u", 1, long), ("u", 0, ["c", *long[10:], "c"]), ("w", 0, list("ab" * 20)), ("w", 1, list("a" * 30)), ("x", 0, long[:25] + ["d"] + long[:25])]
    df = spark.createDataFrame(rows, SCHEMA)
    sizes, refined = [], suffix._refined
    monkeypatch.setattr(suffix, "_refined", lambda ranks, step: (sizes.append(ranks.selectExpr("max(size(suf))").first()[0]), refined(ranks, step))[1])
    key = lambda d: sorted(map(str, d.select(*suffix.PLACE, "rk", "lcp", "prev").collect()))
    assert key(suffix.places(suffix.chained(df, 3))) == key(suffix.ranked(df, 3, prune=False))
    assert len(sizes) > 3 and max(sizes) == 2
    assert found(suffix.clones(df, 3)) == brute(rows, 3)


def test_released_tables_leave_no_shuffle_files(spark, tmp_path):
    """At the end of the write, and not when the driver happens to collect its garbage; the switch is as it was."""
    from reprise import storage

    was = spark.conf.get(storage.CLEAN_UP)
    maps = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = maps.shuffleStatuses().size()
    held = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    out = storage.materialize(held, "held", release=True)
    assert maps.shuffleStatuses().size() <= before
    assert out.count() == 7 and spark.conf.get(storage.CLEAN_UP) == was
    path = storage._paths[out]
    storage.discard(out)
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(path)


def test_copies_are_hashed_and_counted_once(spark, monkeypatch):
    """Of 40 copies of a line one row of tokens gives seeds, not 40; places, ranks and neighbours are those of a plain sort."""
    same = [f"w{i % 9}" for i in range(30)]
    rows = [*[("u", i, same) for i in range(40)], ("v", 0, [*same, "x"]), ("w", 0, ["y", *same[3:]]), ("x", 0, list("abcde"))]
    df, sizes, materialize = spark.createDataFrame(rows, SCHEMA), {}, suffix.materialize

    def counted(df, name, **how):
        out = materialize(df, name, **how)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(suffix, "materialize", counted)
    key = lambda d: sorted(map(str, d.select(*suffix.PLACE, "rk", "lcp", "prev").collect()))
    chains = suffix.chained(df, 5)
    assert sizes["folded"] == 3 and sizes["candidates"] >= 42
    assert key(suffix.places(chains)) == key(suffix.ranked(df, 5, prune=False))


@pytest.mark.parametrize("chunk", [1, 7, 1 << 18])
def test_windows_in_chunks(monkeypatch, chunk):
    """Prints and seeds by their definitions, row by row, whatever a chunk holds, in a batch that is a slice of another."""
    import pyarrow as pa

    from reprise.functions import rolling

    monkeypatch.setattr(rolling, "CHUNK", chunk)
    monkeypatch.setattr(rolling, "_powers", {})
    rng = random.Random(5)
    tokens = [[rng.choice([-5, 7, 1 << 40]) for _ in range(n)] for n in (3, 0, 12, 4, 5, 1, 30, 0)]
    kind = pa.list_(pa.int64())
    batch = pa.record_batch({"nr": pa.array(range(8)), "hashes": pa.array(tokens, kind), "first": pa.array(tokens, kind), "second": pa.array(tokens, kind)}).slice(1)
    made = [r for b in rolling.seeds(4, ["nr"], 40)(iter([batch])) for r in b.to_pylist()]
    assert [(r["nr"], r["off"]) for r in made] == [(i, o) for i in range(1, 8) for o in range(len(tokens[i]) - 3)]
    window = lambda i, o, n=4: tuple(tokens[i][o : o + n])
    for part in ("hi", "lo"):
        value = lambda r: r["hi"] if part == "hi" else r["more"] & 0xFFFFFF0000000000  # noqa: B023, E731
        pairs = {(window(r["nr"], r["off"]), value(r)) for r in made}
        assert len(pairs) == len({w for w, _ in pairs}) == len({v for _, v in pairs})
    after = {(window(r["nr"], r["off"], 5), r["more"] & ((1 << 40) - 1)) for r in made}
    assert all((v == 0) == (len(w) < 5) for w, v in after)
    assert len({v for w, v in after if v}) == len({w[1:] for w, v in after if v})
    grams = {}  # of two tokens
    for t in tokens:
        for o in range(len(t) - 1):
            grams[tuple(t[o : o + 2])] = int(rolling.windows(rolling.np.array(t[o : o + 2]).view("uint64"), 2)[0])
    want = []
    for i in range(1, 8):
        at = [min((grams[window(i, g, 2)], g) for g in range(o, o + 3)) for o in range(len(tokens[i]) - 3)]
        want += [(i, h) for n, (h, g) in enumerate(at) if n == 0 or at[n - 1][1] != g]
    found_prints = [(r["nr"], r["h"] % (1 << 64)) for b in rolling.prints(4, ["nr"])(iter([batch.select(["nr", "hashes"])])) for r in b.to_pylist()]
    assert found_prints == want
