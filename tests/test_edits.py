"""Edit scripts, text edits, document changes and the stream."""

import random

from pyspark.sql import functions as F

from reprise.functions import text as tx
from reprise.operators import documents as dc
from reprise.operators import edits
from reprise.operators import tokens as tk
from reprise.streaming.changes import CloneStore, read_events
from reprise.streaming.progress import listen


def test_scripts_give_the_new_sequence():
    rng = random.Random(3)
    for _ in range(400):
        old, new = ([rng.choice("abc") for _ in range(rng.randrange(0, 15))] for _ in range(2))
        for collapse in (2, 10):
            ops = edits.script(old, new, collapse)
            assert edits.apply_script(old, ops) == new
            assert len(ops) < max(3, collapse)


def test_script_shapes():
    assert edits.script(list("12345"), list("123456789")) == [("INSERT", 5, list("6789"))]
    assert edits.script(list("12345"), list("12215")) == [("SUBSTITUTE", 2, ["2", "1"])]
    assert edits.script(list("123"), list("123")) == []
    assert edits.script([], []) == []
    assert edits.script(list("ab"), []) == [("DELETE", 0, list("ab"))]


def test_script_of_columns(spark):
    pairs = spark.createDataFrame([(1, ["a", "b"], ["b"]), (2, [], ["x"]), (3, ["a"], [])], "id int, old array<string>, new array<string>")
    out = edits.edit_script(pairs).withColumn("got", edits.applied(F.col("old"), F.col("ops")))
    assert all(r.got == r.new for r in out.collect())


def test_text_edits(spark):
    e = "array<struct<start_line:int,start_char:int,end_line:int,end_char:int,text:string>>"
    rows = [
        ("ab\ncd\n", [(0, 1, 1, 1, "X")]),
        ("ab\ncd", [(1, 2, 1, 2, "!")]),  # at the end
        ("ab", [(0, 0, 0, 0, "1\n"), (1, 0, 1, 1, "2")]),
        ("ab", []),
        ("ab", None),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, f"text string, edits {e}").select(tx.apply_edits(F.col("text"), F.col("edits"))).collect()]
    assert got == ["aXd\n", "ab\ncd!", "1\n2b", "ab", "ab"]


def test_upsert_takes_the_last_event(spark):
    docs = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "uri string, text string")
    events = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", None, 3), ("d", "new", 1)], "uri string, text string, version bigint")
    assert sorted(map(tuple, dc.upsert(docs, events).collect())) == [("a", "y"), ("c", "3"), ("d", "new")]
    assert sorted(map(tuple, dc.changed(docs, dc.upsert(docs, events)).collect())) == [("a", "modified"), ("b", "deleted"), ("d", "added")]


def test_ranged_edits_in_order(spark):
    docs = spark.createDataFrame([("a", "x\ny"), ("b", "same")], "uri string, text string")
    kind = "uri string, version int, start_line int, start_char int, end_line int, end_char int, text string"
    rows = [("a", 2, 0, 0, 0, 1, "second "), ("a", 1, 0, 1, 1, 0, "first"), ("gone", 1, 0, 0, 0, 0, "?")]
    out = dc.edited(docs, spark.createDataFrame(rows, kind))
    assert sorted(map(tuple, out.collect())) == [("a", "second firsty"), ("b", "same")]


def test_growing_numbers_of_deletions():
    assert dc.deletions_per_version(1, 5) == [1, 5, 10, 15]
    assert dc.deletions_per_version(7, 3) == [7, 10]


def test_counts_are_maintained(spark):
    make = lambda *t: spark.createDataFrame([("u", i, list(x)) for i, x in enumerate(t)], "uri string, frag_id int, toks array<string>")
    out = tk.merge_counts(tk.token_counts(make("aab")), make("bc"), make("aa"))
    assert {r.token: r.n for r in out.collect()} == {"b": 2, "c": 1}


def test_suffix_array_of_a_word(spark):
    word = spark.createDataFrame([("w", list("mississippi"))], "doc string, toks array<string>")
    assert [r.pos for r in tk.suffix_array(word).orderBy("rk").collect()] == [10, 7, 4, 1, 0, 9, 8, 6, 3, 5, 2]


def test_stream_equals_rebuild(spark, tmp_path):
    line = " ".join(f"w{i}" for i in range(8))
    batches = [
        [("a", line + "\nx y", 1), ("b", "q " + line, 1)],
        [("b", None, 2), ("c", line + " more", 1), ("a", line + "\nx y", 2)],
        [("a", "nothing here", 3)],
    ]
    store, notices = CloneStore(spark, str(tmp_path / "store"), 4), []
    listener = listen(spark, lambda kind, text: notices.append(kind))
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "uri string, text string, version bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        store.start(read_events(spark, str(tmp_path / "events")), str(tmp_path / "checkpoint")).awaitTermination()
        assert store.clones().count() == [2, 2, 0][n]
    assert sorted(r.uri for r in store.documents().collect()) == ["a", "c"]
    spark.streams.removeListener(listener)
    assert "begin" in notices


def test_ranged_edits_in_a_stream(spark, tmp_path):
    """Whole texts, edits in order of versions, deletions and edits of unknown documents; clones as of the last texts."""
    from reprise.operators import suffix
    from reprise.operators.fragments import line_fragments
    from reprise.streaming.changes import RANGED_EVENTS, CloneStore

    store = CloneStore(spark, f"file://{tmp_path}/store", 3)
    batch = lambda rows: spark.createDataFrame(rows, RANGED_EVENTS)
    store.apply(batch([("a", "one two three four\nx", 1, None), ("b", "zero", 1, None), ("b", None, 2, [(0, 0, 0, 4, "one two three"), (0, 13, 0, 13, " five")])]), 0)
    assert {r.uri: r.text for r in store.documents().collect()} == {"a": "one two three four\nx", "b": "one two three five"}
    assert {(r.uri, r.off) for r in store.clones().collect()} == {("a", 0), ("b", 0)}
    store.apply(batch([("a", None, 5, [(1, 0, 1, 1, "y")]), ("a", None, 4, [(0, 4, 0, 7, "2")]), ("c", None, 1, [(0, 0, 0, 0, "lost")]), ("d", "one 2 three six", 1, None)]), 1)
    assert {r.uri: r.text for r in store.documents().collect()} == {"a": "one 2 three four\ny", "b": "one two three five", "d": "one 2 three six"}
    store.apply(batch([("b", None, 6, None), ("e", "one 2 three", 1, None)]), 2)
    assert {r.uri for r in store.documents().collect()} == {"a", "d", "e"} and store.versions() == [1, 2]
    now = sorted(map(str, store.clones().collect()))
    assert now == sorted(map(str, suffix.clones(line_fragments(store.documents()), 3).select(*store.clones().columns).collect())) and len(now) == 3
