"""Quality rules with thresholds that adapt to language and source.

Each document's measures are taken once. Their distributions are kept as relative-error quantile sketches
(DDSketch, Masson, Rim and Lee 2019): a value's bucket is the power of GAMMA above it, and a sketch is the
count of each bucket. Sketches of parts add up to the sketch of the whole, so tasks count before the
shuffle, a language's sketch is the sum of its sources', and any order of tasks gives the same thresholds.
Every group of language and source has its own sketch, to which PRIOR documents are added that are spread as its language's
sketch is, and PRIOR_ALL that are spread as that of all documents; so small groups lean on what contains them, large ones do
not, and no size is treated otherwise. All weights are whole numbers. A threshold lies FENCE interquartile ranges beyond the
outer quartile. Where a group varies less than a measure's least spread, that is taken: on measures that most documents have
none of (symbols, repeats, repeated lines) the threshold is then FENCE least spreads above the quartile whatever the group.
Documents that fail the base rules are not in the sketches.

Defined cases: null, empty and wordless texts have no words and fail the base rules; very long texts are counted whole, and a
worker holds the longest one; null language and source are groups like others; a value that equals its threshold is kept;
repeated rows count each; without any document that passes the base rules there are no thresholds, and an empty table gives no
rows; extra columns have no say, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reprise.llm.common import Words, chunks, materialize, span_hashes, table, windows

MIN_WORDS = 50
MAX_REPEATED = 50  # percent
GAMMA = 1.02
FENCE = 5.0
#: Documents' worth that a group takes from its language and from all documents.
PRIOR = 50
PRIOR_ALL = 10
#: measure: (SQL over the counts, least spread, whether small values are bad too)
MEASURES = {
    "symbols": ("n_symbols / n_words", 0.05, False),
    "punctuation": ("n_punctuation / word_chars", 0.02, False),
    "repeats": ("n_repeat_words / n_words", 0.08, False),
    "dup_lines": ("n_dup_lines / n_lines", 0.1, False),
    "word_length": ("word_chars / n_words", 0.3, True),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_punctuation", "n_lines")
_SYMBOLS = np.isin(np.arange(128), [ord(c) for c in "#*$%&|<>"])
_PUNCTUATION = np.array([33 <= i <= 47 or 58 <= i <= 64 or 91 <= i <= 96 or 123 <= i <= 126 for i in range(128)])


def _twice(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (row, hash): whether it is found twice or more, and whether an equal one sorts before it."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    same = np.zeros(len(r) + 1, dtype=bool)
    same[1:-1] = (r[1:] == r[:-1]) & (h[1:] == h[:-1])
    twice, later = np.zeros(len(r), dtype=bool), np.zeros(len(r), dtype=bool)
    twice[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return twice, later


def counts(texts: list[str]) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    n, words = len(texts), Words(texts)
    codes, text_starts = words.codes, words.text_starts
    plain = np.flatnonzero(codes < 128)

    def of_kind(kind: np.ndarray) -> np.ndarray:
        at = plain[kind[codes[plain]]]
        return np.bincount(np.searchsorted(text_starts, at, "right") - 1, minlength=n)

    # a line ends at a line feed or at the blank after its text
    ends = np.union1d(np.flatnonzero(codes == 10), text_starts[1:] - 1)
    starts = np.r_[0, ends[:-1] + 1]
    filled = np.bincount(np.searchsorted(ends, words.starts), minlength=len(ends)) > 0
    starts, ends = starts[filled], ends[filled]
    line_rows = np.searchsorted(text_starts, starts, "right") - 1
    _, later = _twice(line_rows, span_hashes(codes, starts, ends))
    three = windows(words.hashes, 3)
    inside = np.flatnonzero(words.rows[: len(three)] == words.rows[2:]) if len(three) else np.zeros(0, dtype=np.int64)
    twice, _ = _twice(words.rows[inside], three[inside])
    covered = np.zeros(len(words.rows), dtype=bool)
    for k in range(3):
        covered[inside[twice] + k] = True
    return {
        "n_words": words.counts,
        "word_chars": np.bincount(words.rows, weights=words.ends - words.starts, minlength=n).astype(np.int64),
        "n_symbols": of_kind(_SYMBOLS),
        "n_dup_lines": np.bincount(line_rows[later], minlength=n),
        "n_repeat_words": np.bincount(words.rows[covered], minlength=n),
        "n_punctuation": of_kind(_PUNCTUATION),
        "n_lines": np.bincount(line_rows, minlength=n),
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in chunks(batch):
            found = counts(texts)
            keep = [batch.column(c).slice(a, b - a) for c in ("doc_id", "lang", "source")]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(found[c], pa.int64()) for c in COUNTS)], ["doc_id", "lang", "source", *COUNTS])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def bucket(value: Column) -> Column:
    return F.when(value > 1e-9, F.ceil(F.log(value) / math.log(GAMMA))).otherwise(-100000).cast("int")


def thresholds(measured: DataFrame) -> DataFrame:
    """lang, source, and for each measure high_<measure> (and low_<measure> if small values are bad too)."""
    passing = measured.where(~base_failed())
    rows = F.explode(
        F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.expr(f"cast({sql.split(' / ')[0]} as double) / {sql.split(' / ')[1]}")).alias("bucket")) for m, (sql, _, _) in MEASURES.items()])
    )
    sketch = passing.select("lang", "source", rows.alias("m")).groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count(F.lit(1)).alias("n"))
    sketch = materialize(sketch, "sketch")  # as many rows as groups have buckets
    whole, by = "decimal(38,0)", ["measure", "bucket"]
    total = lambda name, *names: sketch.groupBy(*names, "measure").agg(F.sum("n").cast(whole).alias(name))
    of_all = sketch.groupBy(*by).agg(F.sum("n").alias("n")).join(total("t_all").withColumnRenamed("measure", "m"), F.col("measure") == F.col("m")).drop("m")
    of_lang = sketch.groupBy("lang", *by).agg(F.sum("n").alias("n")).select(F.col("lang").alias("l"), F.col("measure").alias("m"), "bucket", "n")
    sizes = total("t_lang", "lang").join(total("t_all").withColumnRenamed("measure", "m"), F.col("measure") == F.col("m")).drop("m")
    sizes = sizes.select(F.col("lang").alias("l"), F.col("measure").alias("m"), "t_lang", "t_all")
    of = F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m"))
    groups = sketch.select("lang", "source", "measure").distinct().join(sizes, of).drop("l", "m")
    # shares of the language and of all documents, over one denominator
    parts = [
        sketch.join(sizes, of).select("lang", "source", *by, (F.col("n").cast(whole) * F.col("t_lang") * F.col("t_all")).alias("w")),
        groups.join(of_lang, of).select("lang", "source", *by, (F.col("n").cast(whole) * PRIOR * F.col("t_all")).alias("w")),
        groups.join(of_all.select(F.col("measure").alias("m"), "bucket", "n"), F.col("measure") == F.col("m")).select("lang", "source", *by, (F.col("n").cast(whole) * PRIOR_ALL * F.col("t_lang")).alias("w")),
    ]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "source", *by).agg(F.sum("w").cast(whole).alias("w"))
    group = ["lang", "source", "measure"]
    value = F.when(F.col("bucket") == -100000, F.lit(0.0)).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1))
    quartiles = (
        merged.withColumn("below", F.sum("w").over(W.partitionBy(*group).orderBy("bucket")).cast(whole))
        .withColumn("total", F.sum("w").over(W.partitionBy(*group)).cast(whole))
        .withColumn("value", value)
        .groupBy(*group)
        .agg(F.min(F.when(4 * F.col("below") >= F.col("total"), F.col("value"))).alias("q1"), F.min(F.when(4 * F.col("below") >= 3 * F.col("total"), F.col("value"))).alias("q3"))
    )
    spread = F.create_map(*[F.lit(x) for m, (_, least, _) in MEASURES.items() for x in (m, least)])
    reach = FENCE * F.greatest(F.col("q3") - F.col("q1"), spread[F.col("measure")])
    fences = quartiles.withColumn("high", F.col("q3") + reach).withColumn("low", F.col("q1") - reach)
    pick = lambda m, side: F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{side}_{m}")
    return fences.groupBy(F.col("lang").alias("lang0"), F.col("source").alias("source0")).agg(
        *[pick(m, "high") for m in MEASURES], *[pick(m, "low") for m, (_, _, both) in MEASURES.items() if both]
    )


def apply_rules(documents: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed and kept for each row of documents (doc_id, text, lang, source)."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {id_type}, lang string, source string, " + ", ".join(f"{c} bigint" for c in COUNTS)
    docs = documents.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), "text")
    measured = materialize(docs.mapInArrow(_measure, kinds), "measures")
    limits = materialize(thresholds(measured), "thresholds")  # one row a group; its size decides the join
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("lang0")) & F.col("source").eqNullSafe(F.col("source0")), "left")
    beyond = F.lit(False)
    for m, (sql, _, both) in MEASURES.items():
        top, bottom = sql.split(" / ")
        value = F.col(top).cast("double") / F.when(F.col(bottom) > 0, F.col(bottom))
        beyond = beyond | F.coalesce(value > F.col(f"high_{m}"), F.lit(False))
        if both:
            beyond = beyond | F.coalesce(value < F.col(f"low_{m}"), F.lit(False))
    return joined.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & ~beyond).alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    measure = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' AS measure, CASE WHEN {a}::DOUBLE / {b} > 1e-9 THEN CAST(ceil(ln({a}::DOUBLE / {b}) / {math.log(GAMMA)!r}::DOUBLE) AS INT) ELSE -100000 END AS bucket FROM p"
        for m, (sql, _, _) in MEASURES.items()
        for a, b in [sql.split(" / ")]
    )
    spread = "CASE measure " + " ".join(f"WHEN '{m}' THEN {least}::DOUBLE" for m, (_, least, _) in MEASURES.items()) + " END"
    beyond = " OR ".join(
        f"coalesce({sql.split(' / ')[0]}::DOUBLE / nullif({sql.split(' / ')[1]}, 0) > (SELECT high FROM t WHERE t.lang IS NOT DISTINCT FROM c.lang AND t.source IS NOT DISTINCT FROM c.source AND measure = '{m}'), false)"
        + (f" OR coalesce({sql.split(' / ')[0]}::DOUBLE / nullif({sql.split(' / ')[1]}, 0) < (SELECT low FROM t WHERE t.lang IS NOT DISTINCT FROM c.lang AND t.source IS NOT DISTINCT FROM c.source AND measure = '{m}'), false)" if both else "")
        for m, (sql, _, both) in MEASURES.items()
    )
    word, line = r"'[^\x20\x09-\x0D]+'", r"'[^\x20\x09-\x0D]'"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {word}) AS w FROM documents),
x AS (SELECT row, p, list_slice(w, p, p + 2) AS win FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)),
r AS (SELECT row, count(DISTINCT q) AS n FROM (SELECT row, unnest(range(p, p + 3)) AS q FROM (SELECT row, p, count(*) OVER (PARTITION BY row, win) AS k FROM x) WHERE k > 1) GROUP BY row),
l AS (SELECT row, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {line}) GROUP BY row),
c AS (SELECT d.row, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda s: length(s))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(length(regexp_replace(text, '[^!-/:-@\[-`{{-~]', '', 'g')) AS BIGINT) AS n_punctuation,
             CAST(coalesce(l.n, 0) AS BIGINT) AS n_lines
      FROM d LEFT JOIN r ON d.row = r.row LEFT JOIN l ON d.row = l.row),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM c),
p AS (SELECT * FROM f WHERE NOT base_failed),
b AS (SELECT lang, source, measure, bucket, count(*) AS n FROM ({measure}) GROUP BY ALL),
bl AS (SELECT lang, measure, bucket, sum(n) AS n FROM b GROUP BY ALL),
ba AS (SELECT measure, bucket, sum(n) AS n FROM b GROUP BY ALL),
sl AS (SELECT lang, measure, sum(n) AS t_lang FROM b GROUP BY ALL),
sa AS (SELECT measure, sum(n) AS t_all FROM b GROUP BY ALL),
g AS (SELECT DISTINCT b.lang, b.source, b.measure, t_lang, t_all FROM b JOIN sl ON sl.lang IS NOT DISTINCT FROM b.lang AND sl.measure = b.measure JOIN sa ON sa.measure = b.measure),
v AS (SELECT b.lang, b.source, b.measure, b.bucket, b.n * t_lang * t_all AS w FROM b JOIN g ON g.lang IS NOT DISTINCT FROM b.lang AND g.source IS NOT DISTINCT FROM b.source AND g.measure = b.measure
      UNION ALL SELECT g.lang, g.source, g.measure, bl.bucket, bl.n * {PRIOR} * t_all FROM g JOIN bl ON bl.lang IS NOT DISTINCT FROM g.lang AND bl.measure = g.measure
      UNION ALL SELECT g.lang, g.source, g.measure, ba.bucket, ba.n * {PRIOR_ALL} * t_lang FROM g JOIN ba ON ba.measure = g.measure),
s AS (SELECT lang, source, measure, bucket, sum(w) AS w FROM v GROUP BY ALL),
k AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS below, sum(w) OVER (PARTITION BY lang, source, measure) AS total,
             CASE WHEN bucket = -100000 THEN 0.0::DOUBLE ELSE 2 * pow({GAMMA}::DOUBLE, bucket) / ({GAMMA}::DOUBLE + 1) END AS value FROM s),
q AS (SELECT lang, source, measure, min(value) FILTER (4 * below >= total) AS q1, min(value) FILTER (4 * below >= 3 * total) AS q3 FROM k GROUP BY ALL),
t AS (SELECT lang, source, measure, q3 + {FENCE} * greatest(q3 - q1, {spread}) AS high, q1 - {FENCE} * greatest(q3 - q1, {spread}) AS low FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({beyond}) AS kept FROM f AS c
"""


OP6_SQL = _oracle()
