"""Small tables with awkward rows, and what the contract's words are."""

import random
import re
import zlib

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return WORD.findall(text or "")


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def awkward(rng=None):
    """Null and empty texts, nulls in every column, a long text, repeated rows, and some prose."""
    rng = rng or random.Random(1)
    vocabulary = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, prose(rng.randrange(1, 90)), rng.choice(["en", "de"]), rng.choice(["a", "b", "c"]), 1) for i in range(40)]
    rows += [
        (100, None, "en", "a", None), (101, "", "en", None, 0), (102, " \t\n", None, "b", 3), (None, prose(60), "de", "c", 1),
        (103, prose(12_000), "en", "a", 1), (104, "ß é \U0001f600 ​ x", "de", "b", 1), (105, "1 2 3 !!! ...", "en", "c", 1),
        rows[0], rows[0], (106, rows[1][1], "en", "b", 1), (107, None, None, None, None),
    ]
    return rows


def frame(spark, rows=None, extra=False):
    """documents; with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward() if rows is None else rows, DOCS)
    if extra:
        for name in ("score", "row", "size", "n_words", "label", "key", "of", "prints", "target", "bits", "n"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def bag(df, *columns):
    """Rows as a sorted list, the same for equal tables."""
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)
