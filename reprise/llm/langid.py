"""Language identification with string kernels.

A text's features are the presence of its letter n-grams of 1 to MAX_N letters (runs of anything else are
one blank), hashed to BUCKETS positions. The blended-spectrum kernel of two texts is the number of common
features over the geometric mean of their numbers of features. Nyström landmarks make it a small matrix:
with K the landmarks' kernel matrix, a text is its row of kernel values times K^-1/2, and one ridge
regression per language is solved on that. Texts are scored in batches: presence matrix times landmarks,
then times the folded coefficients.

Long texts would fill the buckets, so what is scored are passages: a text is cut into the fewest equal parts of at most
PASSAGE characters, and its probabilities are the mean of those of all its parts that have a letter. The fit sees passages too.

The model is fitted on at most about SAMPLE documents a language, chosen by a hash of their ids; its size
is LANDMARKS x BUCKETS bits and LANDMARKS x languages numbers, whatever the input.

Probabilities are made of scores by a factor that is chosen on a fifth of the sample that the regression has not seen.

Defined cases: a text that is null, empty or has no letter is `und` with score 0; a very long text is scored in all its passages, and
a worker holds the longest one; ties go to the language that is first in code point order; without any learnable document every
text is `und`; an empty table gives no rows; rows with a null id are scored and never learned from; repeated rows are scored
each; extra columns have no say, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.llm.common import carry, chunks, code_points, fold, held_out, table

UNKNOWN = "und"
MAX_N = 4
BUCKETS = 8192
#: Documents a language that the model is fitted on, about.
SAMPLE = 800
LANDMARKS = 256
RIDGE = 1e-3
#: The most characters that are scored at once.
PASSAGE = 2000
#: Besides sample passages the fit sees pieces of so many characters, as short texts look like these.
PIECE = 60
ROWS = 256


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x BUCKETS matrix of 0 and 1 as bytes, whether each text has a letter)."""
    codes, starts = code_points([t.lower() for t in texts])
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(starts))
    letter = _letters()[codes]
    has = np.bincount(owner[letter], minlength=len(texts)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, np.uint32(32))[keep]
    owner = owner[keep]
    out = np.zeros(len(texts) * BUCKETS, dtype=np.uint8)
    h = np.full(len(codes), 0x9E3779B1, dtype=np.uint32)
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    for n in range(1, MAX_N + 1):
        if len(codes) < n:
            break
        m = len(codes) - n + 1
        h = (h[:m] ^ codes[n - 1 :]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        at = owner[:m] * BUCKETS + ((h * np.uint32(0xC2B2AE35)) >> shift)
        out[at if n == 1 else at[owner[:m] == owner[n - 1 :]]] = 1
    return out.reshape(len(texts), BUCKETS), has


def cut(text: str) -> list[str]:
    """The passages of a text; one, empty, of an empty text."""
    k = max(1, -(-len(text) // PASSAGE))
    return [text[len(text) * i // k : len(text) * (i + 1) // k] for i in range(k)]


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # BUCKETS x landmarks, columns divided by their norms
    weights: np.ndarray  # landmarks x languages
    sharpness: float

    def kernel(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32)
        return (x @ self.landmarks) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.sharpness * (self.kernel(x) @ self.weights)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str]) -> Model:
    """x: packed presence bits of the sample, y: the index of each one's language."""
    rng = np.random.default_rng(7)
    share = max(2, LANDMARKS // len(languages))
    chosen = np.concatenate([rng.permutation(np.flatnonzero(y == k))[:share] for k in range(len(languages))])
    unpack = lambda rows: np.unpackbits(rows, axis=1)
    marks = unpack(x[chosen]).astype(np.float32)
    marks /= np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))
    model = Model(languages, marks.T.copy(), np.zeros((len(chosen), len(languages)), dtype=np.float32), 1.0)
    own, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    own = np.maximum(own, own.max() * 1e-6)
    root = vectors / np.sqrt(own) @ vectors.T
    k = np.concatenate([model.kernel(unpack(x[i : i + 1024])) for i in range(0, len(x), 1024)]).astype(np.float64)
    z = k @ root
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = (1 / np.bincount(y, minlength=len(languages)).clip(1))[y][:, None]  # languages count alike
    unseen = rng.permutation(len(y)) < len(y) // 5
    seen = ~unseen
    solve = lambda rows: np.linalg.solve((z[rows] * weight[rows]).T @ z[rows] + RIDGE * len(languages) * np.eye(z.shape[1]), (z[rows] * weight[rows]).T @ target[rows])
    model.weights = (root @ solve(seen)).astype(np.float32)
    if not unseen.any():
        unseen = seen
    raw, of = k[unseen] @ model.weights, y[unseen]
    best = (np.inf, 1.0)
    for sharpness in np.geomspace(1, 30, 30):
        s = sharpness * raw
        s -= s.max(axis=1, keepdims=True)
        loss = (np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(of)), of]).mean()
        best = min(best, (loss, float(sharpness)))
    model.sharpness = best[1]
    return model


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed features of the passage in the middle of each text and of a piece from there."""
    for batch in batches:
        for a, b, texts in chunks(batch):
            pieces = [t[len(t) // 2 : len(t) // 2 + PIECE] for t in texts]
            langs = batch.column("lang").slice(a, b - a)
            middles = [p[len(p) // 2] for p in map(cut, texts)]
            for part in (middles, pieces):
                for s in range(0, len(part), ROWS):
                    x, has = presence(part[s : s + ROWS])
                    rows = [r.tobytes() for r in np.packbits(x, axis=1)]
                    out = pa.RecordBatch.from_arrays([langs.slice(s, len(rows)), pa.array(rows, pa.binary())], ["lang", "bits"])
                    yield out.filter(pa.array(has))


def train(documents: DataFrame) -> Model | None:
    """Fits on documents (doc_id, text, lang) outside the held-out fold; None if there are none."""
    pool = documents.where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = pool.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each output of the model
    if not counts:
        return None
    place = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20))
    limits = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(SAMPLE / max(SAMPLE, r["n"]) * (1 << 20)))])
    sample = pool.where(place < limits[F.col("lang")])
    rows = sample.select("text", "lang").mapInArrow(_bits, "lang string, bits binary").collect()
    if not rows:
        return None
    rows = sorted((r["lang"], bytes(r["bits"])) for r in rows)  # the order of tasks has no say
    languages = sorted({r[0] for r in rows})
    x = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.uint8).reshape(len(rows), -1)
    index = {k: i for i, k in enumerate(languages)}
    return fit(x, np.array([index[r[0]] for r in rows]), languages)


def _predict(model, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for a, b, texts in chunks(batch):
                total = np.zeros((b - a, len(m.languages) if m else 1))
                lettered = np.zeros(b - a)
                parts = [(row, part) for row, text in enumerate(texts) for part in cut(text)]
                for s in range(0, len(parts), ROWS):
                    x, has = presence([part for _, part in parts[s : s + ROWS]])
                    rows = np.array([row for row, _ in parts[s : s + ROWS]])[has]
                    np.add.at(lettered, rows, 1)
                    if m:
                        np.add.at(total, rows, m.probabilities(x[has]))
                best, has = total.argmax(axis=1), lettered > 0
                names = [m.languages[k] if ok and m else UNKNOWN for k, ok in zip(best, has, strict=True)]
                scores = np.where(has & (m is not None), total[np.arange(b - a), best] / np.maximum(lettered, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in batch.columns[:n]), pa.array(names), pa.array(scores, pa.float64())],
                    [*batch.schema.names[:n], "lang_pred", "score"],
                )

    return run


def predict(documents: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns in `keep`, lang_pred and score for each row of documents."""
    spark = documents.sparkSession
    kept, kinds, n = carry(documents, keep)
    return kept.mapInArrow(_predict(spark.sparkContext.broadcast(model), n), f"{kinds}, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
