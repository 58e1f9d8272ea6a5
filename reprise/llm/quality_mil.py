"""Quality classifier: attention-based multiple-instance learning (Ilse, Tomczak and Welling 2018).

A document is a bag of passages of PASSAGE words; every passage of the whole text is encoded. A passage's
input is SURFACE measures (shares of character kinds, word lengths, repetition) and a histogram of hashed
character pairs and word shapes. The encoder is one tanh layer, the gated attention weighs the passages,
and the weighted sum is scored by a logistic unit. Only document labels train it, by Adam on mini-batches
of bags, on at most about SAMPLE labelled documents chosen by a hash of their ids, of each of which BAG passages are learned
from, evenly over the whole text, so that what the driver holds is bounded (about SAMPLE x BAG x INPUT half floats); the scores are
calibrated on a part of them that the weights have not seen. The model has a fixed size. Scoring sees every passage.

Defined cases: a text without words (null and empty too) is one passage of zeros and gets the same score each time; very long
texts are scored whole, and a worker holds the longest one; with labels of one kind or none at all every score is their mean, or
0.5; an empty table of documents gives no rows; several labels of one document count as the lowest; of rows that share an id the
smallest text is learned from; repeated rows are scored each; extra columns have no say, whatever their names; rows with a null id
are scored and never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.llm.common import Words, carry, chunks, fold, held_out, materialize, table

PASSAGE = 64
#: Labelled documents that the model is fitted on, about.
SAMPLE = 6000
#: Passages of a document that are learned from.
BAG = 48
PAIRS = 192
SURFACE = 18
INPUT = SURFACE + PAIRS
HIDDEN = 32
GATE = 16
ROUNDS = 12
BATCH = 64
THRESHOLD = 0.3


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(passages x INPUT matrix, passages of each text): the words of a text in order, PASSAGE at a time."""
    words = Words(texts)
    n_words = words.counts
    count = np.maximum(1, -(-n_words // PASSAGE))
    base = np.cumsum(count) - count
    total = int(count.sum())
    place = np.arange(len(words.rows)) - words.first[:-1][words.rows]
    of = base[words.rows] + place // PASSAGE
    lengths = words.ends - words.starts
    out = np.zeros((total, INPUT), dtype=np.float32)
    if not len(of):
        return out, count
    sums = lambda x: np.bincount(of, weights=x, minlength=total)
    n = np.maximum(1, sums(np.ones(len(of))))
    chars = np.maximum(1, sums(lengths))
    # the passage of each character inside a word
    inside = np.repeat(of, lengths)
    at = np.repeat(words.starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(int(lengths.sum()))
    c = words.codes[at]
    share = lambda mask: np.bincount(inside[mask], minlength=total) / chars
    first, last = words.codes[words.starts], words.codes[words.ends - 1]
    upper = (c >= 65) & (c <= 90)
    lower = ((c >= 97) & (c <= 122)) | (c >= 192)
    digit = (c >= 48) & (c <= 57)
    sentence_end = (last == 46) | (last == 33) | (last == 63)
    order = np.lexsort((words.hashes, of))
    h, p = words.hashes[order], of[order]
    again = np.zeros(len(of))
    again[order[1:]] = (h[1:] == h[:-1]) & (p[1:] == p[:-1])
    beside = np.zeros(len(of))
    beside[1:] = (words.hashes[1:] == words.hashes[:-1]) & (of[1:] == of[:-1])
    pairs = np.zeros(len(of))
    two = words.hashes[:-1] * np.uint64(3) + words.hashes[1:]
    if len(two):
        order = np.lexsort((two, of[:-1]))
        t, p = two[order], of[:-1][order]
        pairs[order[1:]] = (t[1:] == t[:-1]) & (p[1:] == p[:-1])
    mean = sums(lengths) / n
    columns = [
        share(upper), share(lower), share(digit), share(c == 33), share((c >= 35) & (c <= 38)), share(c == 42), share(c == 124),
        share((c == 46) | (c == 44)), share(~(upper | lower | digit)), np.minimum(mean, 30) / 10,
        np.minimum(np.sqrt(np.maximum(0, sums(lengths.astype(float) ** 2) / n - mean**2)), 30) / 10,
        sums(again) / n, sums(beside) / n, sums(pairs) / n, sums(sentence_end) / n, sums((first >= 65) & (first <= 90)) / n,
        np.minimum(n, PASSAGE) / PASSAGE, sums(lengths == 1) / n,
    ]
    out[:, :SURFACE] = np.stack(columns, axis=1)
    # kinds of characters side by side, letters by kind, everything else by itself
    kind = np.where(upper, 1, np.where(lower, 2, np.where(digit, 3, c))).astype(np.uint32)
    h = (kind[:-1] * np.uint32(0x85EBCA6B)) ^ (kind[1:] * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    slot = ((h * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64) % PAIRS
    histogram = np.bincount(inside[:-1] * PAIRS + slot, minlength=total * PAIRS).reshape(total, PAIRS)
    out[:, SURFACE:] = np.sqrt(histogram / chars[:, None])
    return out, count


@dataclass
class Model:
    """weights: w, b (encoder), v, u, a (gate), z, c (score); mean, scale: of the input; slope, shift: calibration."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def forward(self, x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        starts = np.cumsum(count) - count
        bag = np.repeat(np.arange(len(count)), count)
        h = np.tanh(x @ w["w"] + w["b"])
        t, s = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        e = (t * s) @ w["a"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        attention = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(attention[:, None] * h, starts)
        return {"x": x, "starts": starts, "bag": bag, "h": h, "t": t, "s": s, "attention": attention, "z": z, "out": z @ w["z"] + w["c"]}

    def score(self, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score of each bag, attention of each passage)."""
        if self.constant is not None:
            return np.full(len(count), self.constant), np.repeat(1 / count, count)
        f = self.forward(x, count)
        return 1 / (1 + np.exp(-np.clip(self.slope * f["out"] + self.shift, -30, 30))), f["attention"]

    def gradients(self, x: np.ndarray, count: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(x, count)
        bag, h, t, s, attention = f["bag"], f["h"], f["t"], f["s"], f["attention"]
        d_out = (1 / (1 + np.exp(-f["out"])) - y) / len(y)
        d_z = d_out[:, None] * w["z"]
        d_h = attention[:, None] * d_z[bag]
        d_att = (h * d_z[bag]).sum(axis=1)
        inner = np.add.reduceat(attention * d_att, f["starts"])
        d_e = attention * (d_att - inner[bag])
        d_ts = d_e[:, None] * w["a"]
        d_t, d_s = d_ts * s * (1 - t * t), d_ts * t * s * (1 - s)
        d_h += d_t @ w["v"].T + d_s @ w["u"].T
        d_pre = d_h * (1 - h * h)
        return {
            "w": f["x"].T @ d_pre, "b": d_pre.sum(axis=0), "v": h.T @ d_t, "u": h.T @ d_s,
            "a": (d_e[:, None] * t * s).sum(axis=0), "z": f["z"].T @ d_out, "c": np.array(d_out.sum()),
        }


def _platt(out: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit, by Newton steps on slightly shrunken targets."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x, b = np.stack([out, np.ones_like(out)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (p - target) + 1e-4 * (b - [1.0, 0.0]))
        b = b - step
        if np.abs(step).max() < 1e-6:
            break
    return float(b[0]), float(b[1])


def fit(bags: list[np.ndarray], y: np.ndarray) -> Model:
    if not len(y) or y.min() == y.max():
        return Model(constant=float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(11)
    order = rng.permutation(len(y))
    unseen, seen = order[: len(y) // 5], order[len(y) // 5 :]
    if y[seen].min() == y[seen].max() or len(unseen) == 0 or y[unseen].min() == y[unseen].max():
        unseen = seen = order
    everything = np.concatenate([bags[i] for i in seen])
    m = Model(mean=everything.mean(axis=0), scale=everything.std(axis=0) + 1e-2)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    m.weights = {
        "w": draw(INPUT, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE),
        "a": draw(GATE), "z": draw(HIDDEN), "c": np.zeros((), np.float32),
    }
    first = {k: np.zeros_like(v) for k, v in m.weights.items()}
    second = {k: np.zeros_like(v) for k, v in m.weights.items()}
    step = 0
    for turn in range(ROUNDS):
        rate = 3e-3 * (1 - turn / ROUNDS)
        for some in np.array_split(rng.permutation(seen), max(1, len(seen) // BATCH)):
            x, count = np.concatenate([bags[i] for i in some]), np.array([len(bags[i]) for i in some])
            step += 1
            for k, g in m.gradients(x, count, y[some]).items():
                g = g + 1e-4 * m.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                m.weights[k] = m.weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    out = np.concatenate([m.forward(bags[i], np.array([len(bags[i])]))["out"] for i in unseen])
    m.slope, m.shift = _platt(out, y[unseen])
    return m


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in chunks(batch):
            x, count = passages(texts)
            ends = np.cumsum(count)
            some = [e - n + np.arange(min(n, BAG)) * n // min(n, BAG) for e, n in zip(ends, count, strict=True)]
            rows = [x[at].astype(np.float16).tobytes() for at in some]
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), pa.array(rows, pa.binary())], ["label", "bag"])


def document_labels(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, label: the lowest label of each document."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    return known.groupBy("doc_id").agg(F.min(F.col(column).cast("int")).alias("label"))


def train(documents: DataFrame, labels: DataFrame, column: str = "quality") -> Model:
    """Fits on a hash sample of the labelled documents outside the held-out fold."""
    known = document_labels(labels, column).where(fold(F.col("doc_id")) != 0)
    total = known.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20))
    sample = known.where(place < int(SAMPLE / max(SAMPLE, total) * (1 << 20))).select(F.col("doc_id").alias("of"), "label")
    # SAMPLE rows of a few numbers, about
    times = documents.select("doc_id").join(F.broadcast(sample), F.col("doc_id") == F.col("of")).groupBy("of").agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("times"))
    times = materialize(times, "sample")
    of = lambda some: documents.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("of")).select("of", "label", "text")
    # only texts that share an id are shuffled
    repeated = of(times.where("times > 1")).groupBy("of", "label").agg(F.min("text").alias("text"))
    chosen = of(times.where("times = 1")).unionByName(repeated)
    rows = chosen.select("text", "label").mapInArrow(_bags, "label int, bag binary").collect()
    rows = sorted((r["label"], bytes(r["bag"])) for r in rows)  # the order of tasks has no say
    bags = [np.frombuffer(b, dtype=np.float16).reshape(-1, INPUT).astype(np.float32) for _, b in rows]
    return fit(bags, np.array([float(label) for label, _ in rows]))


def _score(model, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for a, b, texts in chunks(batch):
                x, count = passages(texts)
                scores, _ = m.score(x, count)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in batch.columns[:n]), pa.array(scores, pa.float64())],
                    [*batch.schema.names[:n], "score"],
                )

    return run


def score(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in `keep` and score for each row of documents."""
    kept, kinds, n = carry(documents, keep)
    return kept.mapInArrow(_score(documents.sparkSession.sparkContext.broadcast(model), n), f"{kinds}, score double")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
