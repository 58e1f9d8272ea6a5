"""Benchmark decontamination by winnowing (Schleimer, Wilkerson and Aiken 2003).

Of each GUARD consecutive GRAM-word hashes a text keeps the smallest, so two texts that share a span
of GRAM + GUARD - 1 = 13 words keep a common fingerprint. Document and benchmark fingerprints are
joined; each hit is then extended to every occurrence of the item's windows, on the whole text.

What is sent to all tasks has a fixed size: a bitmap of 2**BITMAP_LOG2 bits over the benchmark's
fingerprints. It only spares the join rows that cannot match, so a larger benchmark costs rows, not
results. Only documents with a fingerprint in the bitmap carry their text past the first pass.

Items with the same windows are one set: a document gets each candidate set once, and the ids of a set's items
are joined to what the set hit. A hot fingerprint is in many documents' rows, never many documents in one row.

Defined cases: null, empty or wordless texts have no words and no hits; very long texts are searched whole, and a worker holds
the longest one; an item with fewer than 13 words is one window of its own length; items without words match nothing; an item
row without an id marks words as hit but is not counted or listed; item rows that share an id are one item; repeated documents are
judged row by row; without documents there are no rows, and without items no hits; extra columns have no say, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.llm.common import Words, carry, chunks, list_array, materialize, mix, table, windows

WINDOW = 13
GRAM = 6
GUARD = WINDOW - GRAM + 1
BITMAP_LOG2 = 23


def winnow(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint): the smallest of each GUARD gram hashes that lie within one text, once a row."""
    h = windows(words.hashes, GRAM)
    n = len(h) - GUARD + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    least = h[:n].copy()
    for k in range(1, GUARD):
        np.minimum(least, h[k : k + n], out=least)
    keep = words.rows[:n] == words.rows[WINDOW - 1 : WINDOW - 1 + n]
    keep[1:] &= (least[1:] != least[:-1]) | (words.rows[1:n] != words.rows[: n - 1])
    return words.rows[:n][keep], least[keep]


def runs(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of `size` words within a text."""
    h = windows(words.hashes, size)
    if not len(h):
        return np.zeros(0, dtype=np.int64), h
    inside = words.rows[: len(h)] == words.rows[size - 1 :]
    return words.rows[: len(h)][inside], h[inside]


def _salted(h: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of short items, told apart by length from each other and from gram hashes."""
    return mix(h + np.uint64(size))


def _by_row(rows: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType = pa.int64()) -> pa.Array:
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return list_array(values[new].view(np.int64), np.bincount(rows[new], minlength=n), kind)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per item: its window size, the hashes of its windows and its fingerprints."""
    for batch in batches:
        for a, b, texts in chunks(batch):
            words, n = Words(texts, plain=True), b - a
            sizes = np.minimum(words.counts, WINDOW)
            rows, wins = runs(words, WINDOW)
            pr, pv = winnow(words)
            rows, wins, pr, pv = [rows], [wins], [pr], [pv]
            for size in range(1, WINDOW):
                r, h = runs(words, size)
                short = words.counts[r] == size
                rows.append(r[short])
                wins.append(h[short])
                pr.append(r[short])
                pv.append(_salted(h[short], size))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item").slice(a, n),
                    pa.array(sizes, pa.int32()),
                    _by_row(np.concatenate(rows), np.concatenate(wins), n),
                    _by_row(np.concatenate(pr), np.concatenate(pv), n),
                ],
                ["item", "size", "wins", "prints"],
            )


def _documents(bitmap, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, at = bitmap.value, TaskContext.get().partitionId() << 36
        for batch in batches:
            for a, b, texts in chunks(batch):
                words, n = Words(texts, plain=True), b - a
                found = [winnow(words)]
                for size in sizes:
                    r, h = runs(words, size)
                    found.append((r, _salted(h, size)))
                rows, prints = (np.concatenate(x) for x in zip(*found, strict=True))
                slot = (prints >> np.uint64(64 - BITMAP_LOG2)).astype(np.int64)
                hit = (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
                lists = _by_row(rows[hit], prints[hit], n)
                some = np.diff(lists.offsets.to_numpy()) > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(at, at + n)),
                        *(batch.column(c).slice(a, n) for c in range(batch.num_columns - 1)),
                        pa.array(words.counts, pa.int64()),
                        lists,
                        pa.array([t if s else None for t, s in zip(texts, some, strict=True)], pa.string()),
                    ],
                    ["row", *batch.schema.names[:-1], "n_words", "prints", "text"],
                )
                at += n

    return run


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks the words of every occurrence of the candidate sets' windows; the sets that occur."""
    for batch in batches:
        hits, found = [], []
        for text, sets in zip(batch.column("text"), batch.column("sets"), strict=True):
            marked, keys = 0, []
            if sets.is_valid:
                words = Words([text.as_py()], plain=True)
                mark = np.zeros(len(words.starts) + 1, dtype=np.int64)
                names, sizes, wins = (sets.values.field(c) for c in ("key", "size", "wins"))
                names, sizes = names.to_numpy(), sizes.to_numpy()
                flat, lengths = wins.flatten().to_numpy().view(np.uint64), np.diff(wins.offsets.to_numpy())
                owner = np.repeat(np.arange(len(sizes)), lengths)
                there = np.zeros(len(sizes), dtype=bool)
                for size in np.unique(sizes):
                    h = windows(words.hashes, int(size))
                    of = sizes[owner] == size
                    at = np.flatnonzero(np.isin(h, flat[of]))
                    mark[at] += 1
                    mark[at + size] -= 1
                    there[owner[of & np.isin(flat, h)]] = True
                keys = names[there]
                marked = int((np.cumsum(mark) > 0).sum())
            hits.append(marked)
            found.append(keys)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(hits, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["row", "n_hit", "keys"]
        )


def contamination(documents: DataFrame, benchmark: DataFrame, keep: list[str], item_id: str = "item_id") -> DataFrame:
    """The columns in `keep`, n_words, n_hit, n_items, items (ids as sorted strings), items_sha256 and contaminated
    for each row of documents; none of `keep` may be text or be named like the others."""
    spark = documents.sparkSession
    kept, kinds, _ = carry(documents, keep)
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), "text").mapInArrow(
        _items, "item string, size int, wins array<bigint>, prints array<bigint>"
    )
    items = materialize(items.where("size > 0"), "items")
    slot = F.expr(f"shiftrightunsigned(print, {64 - BITMAP_LOG2})")
    bits = np.zeros((1 << BITMAP_LOG2) // 64, dtype=np.uint64)
    prints = items.select(F.explode("prints").alias("print"))
    # at most 2**BITMAP_LOG2 / 64 rows, however large the benchmark is
    cells = prints.groupBy(F.shiftright(slot, 6).alias("cell")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(print, {64 - BITMAP_LOG2}) & 63 as int))")).alias("bits")
    )
    for cell, value in cells.collect():
        bits[cell] = np.int64(value).view(np.uint64)
    short = sorted(r[0] for r in items.where(F.col("size") < WINDOW).select("size").distinct().collect())  # 12 at most
    docs = kept.mapInArrow(
        _documents(spark.sparkContext.broadcast(bits), short), f"row bigint, {kinds}, n_words bigint, prints array<bigint>, text string"
    )
    docs = materialize(docs, "prints")
    keyed = items.select(F.xxhash64("size", "wins").alias("key"), "item", "size", "wins", "prints")
    sets = materialize(keyed.drop("item").dropDuplicates(["key"]), "sets")
    candidates = (
        docs.select("row", F.explode("prints").alias("print"))
        .join(sets.select("key", F.explode("prints").alias("print")), "print")
        .select("row", "key")
        .distinct()
        .join(sets.select("key", "size", "wins"), "key")
        .groupBy("row")
        .agg(F.collect_list(F.struct("key", "size", "wins")).alias("sets"))
    )
    texts = docs.where(F.col("text").isNotNull()).select("row", "text")
    hits = texts.join(candidates, "row").select("row", "text", "sets").mapInArrow(_extend, "row bigint, n_hit bigint, keys array<bigint>")
    hits = materialize(hits.where("n_hit > 0"), "hits")
    ids = keyed.where(F.col("item").isNotNull()).groupBy("key").agg(F.collect_set("item").alias("ids"))
    named = hits.select("row", F.explode("keys").alias("key")).join(ids, "key").groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    found = hits.select("row", "n_hit").join(named, "row", "left")
    out = docs.drop("prints", "text").join(found, "row", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("bigint")))
    out = out.withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select(
        *keep, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"]).drop("items")


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark),
sizes AS (SELECT DISTINCT least(len(w), 13) AS k FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, list_slice(w, p, p + least(len(w), 13) - 1) AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM b WHERE len(w) > 0)),
dw AS (SELECT row, k, p, list_slice(w, p, p + k - 1) AS win
       FROM (SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes WHERE len(w) >= k)),
h AS (SELECT dw.row, dw.k, dw.p, iw.item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
hit AS (SELECT row, count(DISTINCT q) AS n_hit FROM (SELECT row, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT row, k, p FROM h)) GROUP BY row),
it AS (SELECT row, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
       FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS i FROM h WHERE item_id IS NOT NULL) GROUP BY row)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN it USING (row)
"""
