"""Text kernels and session helpers that the training-data operators share.

Text is handled a bounded chunk of documents at a time: the chunk's texts become one array of code
points, and words, hashes and counts are numpy passes over that array. Memory per task is set by
CHUNK_CHARS, or by the longest single text if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.functions.bitmaps import bitmap_cells, may_match
from reprise.storage import materialize, new_path, scratch

__all__ = ["bitmap_cells", "materialize", "may_match", "new_path", "scratch"]

#: Words everywhere in this subpackage: runs of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_CHARS = 250_000
_ROWS = 256

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; 0 is held out, null ids have no fold and are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def carry(documents: DataFrame, keep: list[str]) -> tuple[DataFrame, str, int]:
    """(the columns of `keep` and text behind them, the DDL of those to hand on, how many they are).

    text is handed on, as the last, only if `keep` has it.
    """
    kept = documents.select(*[c for c in keep if c != "text"], F.col("text"))
    fields = kept.schema.fields if "text" in keep else kept.schema.fields[:-1]
    return kept, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), len(fields)


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int, list]]:
    """(from, to, texts) of runs of rows with at most `limit` characters, one row at least; null is ''."""
    values, start, used, texts = batch.column(column), 0, 0, []
    for first in range(0, batch.num_rows, _ROWS):  # a batch's texts are not held as Python strings all at once
        for t in values.slice(first, _ROWS).to_pylist():
            t = t or ""
            if texts and used + len(t) > limit:
                yield start, start + len(texts), texts
                start, used, texts = start + len(texts), 0, []
            texts.append(t)
            used += len(t) + 1
    if texts:
        yield start, start + len(texts), texts


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points with one space after each, and where each text starts (and the end)."""
    joined = " ".join([*texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return codes, starts


def is_space(codes: np.ndarray) -> np.ndarray:
    return (codes == 32) | ((codes >= 9) & (codes <= 13))


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK_CHARS + 1024)
        values = np.full(size, base, dtype=np.uint64)
        values[0] = 1
        np.cumprod(values, out=values)
        if size > 4 * CHUNK_CHARS:
            return values
        _powers[name] = have = values
    return have[:n]


def hash_sums(codes: np.ndarray) -> np.ndarray:
    """What `summed_hashes` takes: sums of the hashed codes up to each place."""
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    x = codes.astype(np.uint64)
    x += np.uint64(0x1F3D5B79)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= _power("up", _BASE, len(codes))
    np.cumsum(x, out=sums[1:])
    return sums


def summed_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """`span_hashes` of the codes that `hash_sums` was given."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    return mix((sums[ends] - sums[starts]) * _power("down", pow(_BASE, -1, 1 << 64), len(sums) - 1)[starts])


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of codes[s:e] for each span, the same wherever the span stands."""
    return summed_hashes(hash_sums(codes), starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)


#: Which code points are in plain words, the last one for all from 128 on.
_PLAIN = np.array([chr(c).isalnum() and not chr(c).isupper() or c == 128 for c in range(129)])


class Words:
    """The words of a chunk: start, end, the row they are in, and a hash of each.

    plain: words are runs of digits, a-z and code points from 128 on, after lower-casing A-Z. points: the texts' code points.
    """

    def __init__(self, texts: list[str], hashes: bool = True, plain: bool = False, points: tuple[np.ndarray, np.ndarray] | None = None):
        self.codes, self.text_starts = points or code_points(texts)
        if plain:
            upper = np.flatnonzero(self.codes - np.uint32(65) < 26)
            if len(upper):
                self.codes = self.codes.copy()
                self.codes[upper] += 32
            inside = _PLAIN[np.minimum(self.codes, np.uint32(128))]
        else:
            inside = ~is_space(self.codes)
        self.starts, self.ends = spans(inside)
        self.first = np.searchsorted(self.starts, self.text_starts)  # of each row's words; the last is the count
        self.counts = np.diff(self.first)
        self.rows = np.repeat(np.arange(len(texts)), self.counts)
        self.sums = hash_sums(self.codes) if hashes else None
        self.hashes = summed_hashes(self.sums, self.starts, self.ends) if hashes else None


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` hashes; the caller drops runs that cross a text's end."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0xBF58476D1CE4E5B9) + hashes[k : k + n]
    return mix(out)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of `size` words within a text; a shorter text with words is one run."""
    all_rows, all_hashes = [], []
    h = windows(words.hashes, size)
    whole = words.rows[: len(h)] == words.rows[size - 1 :] if len(h) else np.zeros(0, dtype=bool)
    all_rows.append(words.rows[: len(h)][whole])
    all_hashes.append(h[whole])
    for k in range(1, size):
        short = np.flatnonzero(words.counts == k)
        if len(short):
            at = words.first[short]
            out = np.full(len(short), k, dtype=np.uint64)
            for i in range(k):
                out = out * np.uint64(0xBF58476D1CE4E5B9) + words.hashes[at + i]
            all_rows.append(short)
            all_hashes.append(mix(out))
    return np.concatenate(all_rows), np.concatenate(all_hashes)


def bitmap(cells: DataFrame, log2: int) -> np.ndarray:
    bits = np.zeros((1 << log2) // 64, dtype=np.uint64)
    found = cells.toArrow()
    bits[found["cell"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = (keys >> np.uint64(64 - (len(bits) * 64).bit_length() + 1)).astype(np.int64)
    return (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
