"""Hashes of all windows of fixed size over arrays of token hashes: numpy passes over a bounded chunk of fragments.

The hash of a window is made from sums over the chunk, so its cost does not grow with the window's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Tokens in a chunk, or those of the longest fragment if that is longer.
CHUNK = 1 << 18
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, np.ndarray] = {}

Batches = Iterator[pa.RecordBatch]


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base^2 and so on; those of a chunk's length are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK), base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if len(have) <= CHUNK:
            _powers[base] = have
    return have[:n]


def windows(tokens: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash of each run of `size` tokens, the same wherever it stands; `which` of two independent ones."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    base = _BASES[which]
    sums = np.zeros(len(tokens) + 1, dtype=np.uint64)
    np.cumsum(tokens * _power(base, len(tokens)), out=sums[1:])
    h = (sums[size:] - sums[:n]) * _power(pow(base, -1, 1 << 64), n)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h ^= h >> np.uint64(33)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def least(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each `width` elements in a row, and where it is (the first of equal ones)."""
    at, have = np.arange(len(h)), 1
    while have < width and len(h):
        step = min(have, width - have)
        n = max(0, len(h) - step)
        right = h[step:] < h[:n]
        h, at, have = np.where(right, h[step:], h[:n]), np.where(right, at[step:], at[:n]), have + step
    return h, at


def chunks(batch: pa.RecordBatch, arrays: list[str]) -> Iterator[tuple[slice, np.ndarray, list[np.ndarray]]]:
    """(rows, their lengths, the tokens of each of `arrays` one behind another) of runs of rows with at most CHUNK tokens, one row at least."""
    columns = [batch.column(c) for c in arrays]
    ends = columns[0].offsets.to_numpy()
    bases = [c.offsets[0].as_py() - int(ends[0]) for c in columns]
    values = [c.values.to_numpy(zero_copy_only=False).view(np.uint64) for c in columns]
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK, side="right")) - 1)
        yield slice(first, last), np.diff(ends[first : last + 1]), [v[ends[first] + b : ends[last] + b] for v, b in zip(values, bases)]
        first = last


def places(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row, place in the chunk) of every window of `size` tokens that lies in one row."""
    counts = np.maximum(lengths.astype(np.int64) - size + 1, 0)
    rows = np.repeat(np.arange(len(lengths)), counts)
    off = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    return rows, off, off + np.repeat(np.cumsum(lengths.astype(np.int64)) - lengths, counts)


def prints(threshold: int, keep: list[str]) -> Callable[[Batches], Batches]:
    """The columns of `keep` and h: of the hashes of threshold / 2 tokens in each window of `threshold` the least, once where
    the next windows have the same. Tokens are in `hashes`."""
    gram = max(1, threshold // 2)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part, lengths, (tokens,) in chunks(batch, ["hashes"]):
                rows, off, at = places(lengths, threshold)
                if not len(rows):
                    continue
                h, where = least(windows(tokens, gram), threshold - gram + 1)
                where = where[at]
                new = (off == 0) | (where != np.concatenate([where[:1], where[:-1]]))
                held = batch.slice(part.start, part.stop - part.start).select(keep).take(pa.array(rows[new]))
                yield pa.RecordBatch.from_arrays([*held.columns, pa.array(h[at[new]].view(np.int64))], names=[*keep, "h"])

    return run


def seeds(threshold: int, keep: list[str], next_bits: int) -> Callable[[Batches], Batches]:
    """The columns of `keep`, off, hi and more of each window of `threshold` tokens: its first hash, and behind the lower bits of
    its second one the upper `next_bits` of the next window's (0: none). Tokens are in `first` and `second`."""
    down, up = np.uint64(64 - next_bits), np.uint64(next_bits)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part, lengths, (first, second) in chunks(batch, ["first", "second"]):
                rows, off, at = places(lengths, threshold)
                if not len(rows):
                    continue
                hi, lo = windows(first, threshold)[at], windows(second, threshold, 1)[at]
                after = np.zeros_like(lo)
                after[:-1] = np.where(rows[1:] == rows[:-1], lo[1:] >> down, np.uint64(0))
                made = [off.astype(np.int32), hi.view(np.int64), ((lo << up) | after).view(np.int64)]
                held = batch.slice(part.start, part.stop - part.start).select(keep).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*held.columns, *map(pa.array, made)], names=[*keep, "off", "hi", "more"])

    return run
