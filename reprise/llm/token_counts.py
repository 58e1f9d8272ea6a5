"""Token counts of documents under a unigram segmentation, with dynamic programming shared over a trie.

Texts are split at white space into pre-tokens, each with a word mark in front. The best segmentation of a
pre-token is the one with the highest sum of piece scores; its prefixes' best scores do not depend on what
follows, so the distinct pre-tokens of a chunk go into a trie and each node (a shared prefix) is scored
once, a depth at a time for all pre-tokens together. Terminal nodes keep the number of pieces, and a
document's count is the sum over its pre-tokens. A worker remembers up to KNOWN pre-tokens between chunks.

Pre-tokens of more than LONGEST characters, which share no more than that with others in practice, are paths of their own:
the pieces that end at each of a path's nodes are found for all nodes at once, and the same recurrence runs along the path.

The pieces come from a public vocabulary file whose path is a parameter, read by the driver only. Such files hold ranks, not
probabilities, and tokenizers are not trained here, so the ranks give the scores: piece r has the log-probability of rank r
under Zipf's law. A character without a piece costs its UTF-8 bytes.

Defined cases: null, empty and wordless texts have no tokens; very long texts and pre-tokens are counted whole, and a worker holds
the longest text; equal scores go to the segmentation with fewer pieces; repeated rows are counted each; an empty table gives no
rows; extra columns have no say, whatever their names; a missing vocabulary file is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.llm.common import Words, carry, chunks, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Pre-tokens that a worker remembers, and the longest that share nodes.
KNOWN = 2_000_000
LONGEST = 256
_B = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1


@dataclass
class Vocabulary:
    """Hashes of the pieces, sorted, and their scores; scores by text too."""

    key: int
    hashes: np.ndarray
    scores: np.ndarray
    longest: int
    byte: float
    pieces: dict[str, float]


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * _B + (ord(c) + 1) * 0xD6E8FEB86659FD93) & _M
    return h


def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    import os

    import sentencepiece

    if not os.path.isfile(path):
        raise FileNotFoundError(f"no vocabulary file at {path}: give the path of a sentencepiece model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
    total = np.log((1 / np.arange(1, len(names) + 1)).sum())
    # single characters stand last in such files by construction, bytes first; longer pieces are by rank
    ranked = sorted(names, key=lambda p: p.startswith("<0x") and len(p) == 6)
    pieces = {p: float(-np.log(r + 1) - total) for r, p in enumerate(ranked)}
    byte = min(pieces.values())
    plain = {p: s for p, s in pieces.items() if not (p.startswith("<0x") and len(p) == 6)}
    hashes = np.array([_hash(p) for p in plain], dtype=np.uint64)
    order = np.argsort(hashes)
    return Vocabulary(hash((path, len(plain))), hashes[order], np.array(list(plain.values()))[order], max(map(len, plain)), byte, plain)


def path_count(codes: np.ndarray, v: Vocabulary) -> int:
    """Pieces of the best segmentation of MARK + codes, as one path of a trie."""
    char = np.r_[ord(MARK), codes].astype(np.int64)
    n = len(char)
    size = 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)
    step = (char + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    tails, ends, lengths, scores = np.zeros(n, dtype=np.uint64), [], [], []
    for k in range(1, min(n, v.longest) + 1):
        # hashes of the k characters that end at each node from the k-th on
        tails = tails[:-1] * np.uint64(_B) + step[k - 1 :] if k > 1 else step
        at = np.minimum(np.searchsorted(v.hashes, tails), len(v.hashes) - 1)
        hit = np.flatnonzero(v.hashes[at] == tails)
        ends.append(hit + k)
        lengths.append(np.full(len(hit), k))
        scores.append(v.scores[at[hit]])
    end, length, score = (np.concatenate(x) for x in (ends, lengths, scores))
    order = np.lexsort((length, end))
    first = np.searchsorted(end[order], np.arange(1, n + 2)).tolist()
    length, score, size = length[order].tolist(), score[order].tolist(), size.tolist()
    best, pieces = [0.0] * (n + 1), [0] * (n + 1)
    for e in range(1, n + 1):
        top, least = best[e - 1] + size[e - 1] * v.byte, pieces[e - 1] + size[e - 1]
        for i in range(first[e - 1], first[e]):
            s, p = best[e - length[i]] + score[i], pieces[e - length[i]] + 1
            if s > top or (s == top and p < least):
                top, least = s, p
        best[e], pieces[e] = top, least
    return pieces[n]


def trie_counts(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Pieces of the best segmentation of MARK + codes[s:e] for each pre-token."""
    out = np.zeros(len(starts), dtype=np.int64)
    lengths = ends - starts
    # depth 0 is the empty prefix, depth 1 the mark that all share
    scores, pieces, parents = [np.zeros(1)], [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)]
    tails = np.zeros((1, v.longest + 1), dtype=np.uint64)  # of each node: hashes of its last 1, 2, ... characters
    node = np.zeros(len(starts), dtype=np.int64)
    alive = np.arange(len(starts))
    for depth in range(1, int(lengths.max(initial=0)) + 2):
        if depth == 1:
            chars = np.full(len(alive), ord(MARK), dtype=np.int64)
        else:
            chars = codes[starts[alive] + depth - 2].astype(np.int64)
        nodes, inverse = np.unique((node[alive] << 21) | chars, return_inverse=True)
        node[alive] = inverse
        parent, char = nodes >> 21, nodes & 0x1FFFFF
        parents.append(parent)
        new = np.zeros((len(nodes), v.longest + 1), dtype=np.uint64)
        new[:, 1:] = tails[parent, :-1] * np.uint64(_B) + ((char + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[:, None]
        tails = new
        size = 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)
        best = scores[depth - 1][parent] + size * v.byte
        count = pieces[depth - 1][parent] + size
        above = np.arange(len(nodes))
        for k in range(1, min(depth, v.longest) + 1):
            above = parents[depth - k + 1][above]
            at = np.minimum(np.searchsorted(v.hashes, tails[:, k]), len(v.hashes) - 1)
            hit = np.flatnonzero(v.hashes[at] == tails[:, k])
            if not len(hit):
                continue
            s = scores[depth - k][above[hit]] + v.scores[at[hit]]
            n = pieces[depth - k][above[hit]] + 1
            better = (s > best[hit]) | ((s == best[hit]) & (n < count[hit]))
            best[hit[better]], count[hit[better]] = s[better], n[better]
        scores.append(best)
        pieces.append(count)
        if depth > v.longest:  # too far above to matter
            scores[depth - v.longest - 1] = pieces[depth - v.longest - 1] = None
        done = lengths[alive] == depth - 1
        out[alive[done]] = count[node[alive[done]]]
        alive = alive[~done]
    return out


_known: dict = {}


def word_counts(words: Words, v: Vocabulary) -> np.ndarray:
    """Pieces of each word of a chunk."""
    if _known.get("key") != v.key:
        _known.update(key=v.key, hashes=np.zeros(0, np.uint64), counts=np.zeros(0, np.int64))
    distinct, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    at = np.minimum(np.searchsorted(_known["hashes"], distinct), max(0, len(_known["hashes"]) - 1))
    have = _known["hashes"][at] == distinct if len(_known["hashes"]) else np.zeros(len(distinct), dtype=bool)
    found = np.zeros(len(distinct), dtype=np.int64)
    found[have] = _known["counts"][at[have]] if have.any() else 0
    missing = np.flatnonzero(~have)
    starts, ends = words.starts[first[missing]], words.ends[first[missing]]
    long = ends - starts > LONGEST
    fresh = np.zeros(len(missing), dtype=np.int64)
    fresh[~long] = trie_counts(words.codes, starts[~long], ends[~long], v)
    for i in np.flatnonzero(long):
        fresh[i] = path_count(words.codes[starts[i] : ends[i]], v)
    found[missing] = fresh
    if len(missing):
        hashes, counts = distinct[missing], fresh
        if len(_known["hashes"]) + len(missing) <= KNOWN:
            hashes, counts = np.concatenate([_known["hashes"], hashes]), np.concatenate([_known["counts"], counts])
        order = np.argsort(hashes)
        _known.update(hashes=hashes[order], counts=counts[order])
    return found[inverse]


def _count(vocabulary_of, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_of.value
        for batch in batches:
            for a, b, texts in chunks(batch):
                words = Words(texts)
                tokens = np.bincount(words.rows, weights=word_counts(words, v), minlength=b - a).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in batch.columns[:n]), pa.array(words.counts, pa.int64()), pa.array(tokens)],
                    [*batch.schema.names[:n], "n_words", "n_tokens"],
                )

    return run


def count_tokens(documents: DataFrame, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """The columns in `keep`, n_words and n_tokens for each row of documents."""
    kept, kinds, n = carry(documents, keep)
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary(path))  # the file's size bounds it
    return kept.mapInArrow(_count(shared, n), f"{kinds}, n_words bigint, n_tokens bigint")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), ["doc_id"], VOCABULARY)
