"""Toxicity: class-conditional Kneser-Ney models of characters and of words, compared by length-normalised likelihood.

Texts become symbols: the ALPHABET most frequent letters and digits (learned, in lower case), one symbol for all others, and
one blank for each run of anything else, and are predicted from the symbols before them in their word. Both classes' models are
of order ORDER with interpolated Kneser-Ney smoothing. The highest order counts one class's texts; all lower orders are
continuation counts over both classes together, so expressions that are rare in a class fall back on shared counts and favour
neither. A text's measures are the mean log-likelihood ratio of its symbols and that of its most toxic stretch of so many words
as STRETCHES says; a logistic unit calibrates them on labelled documents under counts that have not seen them. Length is no measure.

A second model has words, as they are written in any script, across blanks from the start of a text to its end: class-conditional
counts of words after the word before them, backed by those of words after their stem (the first STEM characters), those of
stems, and last shared counts: of how many different words a stem is the stem. Every word, pair of words and stem that a labelled
text of either class has is counted, however rare it is and however little it tells. These counts are a table that grows with
the labelled texts; texts meet it in a join. The measures are the mean ratio of a text's words, the highest joint ratio of a word
or pair in it, and the mean of what its stems have in favour of the toxic class beyond MARGIN. For callers that want a smaller
table, `counted` and `word_model` can do with expressions alone: words and pairs that toxic texts have LEAST times or more, at
RATE times the rate of ordinary texts or more, and the words of such pairs. The query never does.

What goes to all tasks has a fixed size: one number for each of the 2**(5 * ORDER) possible n-grams of symbols, the values of
the HOT most frequent keys, whose rows would meet in a few tasks, and two bitmaps, of labelled ids and of the
keys in the table, that spare shuffled rows which cannot match. In a larger corpus they spare fewer rows (a bitmap of 2**26 bits
is half full at 23 million keys, which have two places each), and lose none.

The calibration sees every labelled document outside the held-out fold, under counts of the half that it is not in. The
counts that then score every row are of all of these documents together. Its sums are made where the measures are, so the
driver gets a fixed number of them from each task.

Defined cases: a text without a letter or digit (null and empty too) has ratios of 0; very long texts are scored whole, and a
worker holds the longest one; if labels are of one kind every score is their mean, and 0.5 if there are none; an empty table of
documents gives no rows; several labels of one document count as the lowest; repeated rows are scored and counted each; equal
frequencies go to the smaller key; extra columns have no say, whatever their names; rows with a null id are scored and never
learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.llm.common import CHUNK_CHARS, Words, bitmap_cells, carry, chunks, code_points, fold, held_out, in_bitmap, list_array, materialize, may_match, spans, summed_hashes, table
from reprise.storage import discard, released

ORDER = 4
CELLS = 1 << (5 * ORDER)
STRETCHES = (3,)
CHARACTER_MEASURES = ("mean_ratio", *(f"top_ratio_{k}" for k in STRETCHES))
MEASURES = (*CHARACTER_MEASURES, "word_mean", "word_top", "stem_plus")
THRESHOLD = 0.5
#: In the place of a word's hash: the ends of a text.
START, END = 1, 2
#: What a counted row is.
PAIRS, WORDS, STEMS, SYMBOLS = 0, 1, 2, 3
#: A bucket's row that says how many pairs, words and stems are counted once and twice.
RARE = 4
#: Characters of a stem.
STEM = 5
#: What a stem has to have in favour of the toxic class before it counts in stem_plus.
MARGIN = 2.0
#: Fewest occurrences of an expression in toxic texts, and how often their rate has to be that of ordinary ones.
LEAST = 2
RATE = 2
#: Words and pairs that are looked up where the texts are; all others by a join.
HOT = 1 << 18
#: Letters and digits with a symbol of their own, and those of a model that has learned none.
ALPHABET = 30
LATIN = "abcdefghijklmnopqrstuvwxyz"
ID_BITS, KEY_BITS = 25, 26
#: The table and what asks for its values meet by this many of a hash's first bits.
BUCKET_BITS = 10
#: Counted rows that a task holds, about, in 34 bytes each, and asked ones.
_HELD = 1_000_000
#: Words that counted rows have by their place in a list, in 2 bytes instead of 8; what is counted is the same with any list.
WRITTEN = (1 << 16) - 1
#: Parts of the documents that ask, and of the table that answer, one after another.
ROUNDS = 3
#: Parts of a table that are made, and those of a half's table that answer, one after another.
HALF_PARTS = 2
#: A key is looked up where the texts are only if it is counted this often.
_OFTEN = 4


@cache
def _symbols(alphabet: str) -> np.ndarray:
    """Code point -> symbol."""
    known = np.char.isalnum(np.arange(0x110000, dtype=np.uint32).view("U1"))
    out = np.where(known, np.uint8(ALPHABET + 1), np.uint8(0))
    for k, c in enumerate(alphabet[:ALPHABET], 1):
        out[ord(c)] = k
    return out


def lowered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """`code_points` of the texts in lower case."""
    return code_points([t.lower() for t in texts])


def ngrams(texts: list[str], alphabet: str = LATIN, points: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram) for each symbol of each text: the symbol with the ORDER - 1 before it in its word, blanks before them.

    points: what `lowered` has of the texts."""
    codes, starts = points or lowered(texts)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(starts))
    symbol = _symbols(alphabet)[codes]
    keep = symbol > 0
    keep[1:] |= symbol[:-1] > 0
    symbol, owner = symbol[keep], owner[keep]
    inside = np.zeros(len(symbol), dtype=bool)  # whether there is no blank right before
    inside[1:] = symbol[:-1] > 0
    out, before = symbol.astype(np.uint32), symbol
    for k in range(1, ORDER):
        # the symbol k places before, or a blank if there is one on the way to it
        before = np.r_[np.zeros(1, np.uint8), before[:-1]][: len(symbol)] * (inside if k > 1 else np.uint8(1))
        out |= before.astype(np.uint32) << np.uint32(5 * k)
    return owner, out


def _ordered(keys: np.ndarray) -> np.ndarray:
    """Places of the keys in their order, by as many leading bits as leave room for the places. Sorting numbers is much
    faster than sorting their places; equal keys may stand apart if others share these bits."""
    width = np.uint64(len(keys).bit_length())
    at = np.sort(keys >> width << width | np.arange(len(keys), dtype=np.uint64))
    return (at & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct key, which of these each key is). A key may count as two if others share its leading bits."""
    order = _ordered(keys)
    at = _firsts(keys[order])
    which = np.empty(len(keys), dtype=np.int64)
    which[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(keys))))
    return order[at], which


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters and digits by code (word is false) and the task's WRITTEN most frequent words by hash (word is true), and their counts."""
    total = np.zeros(0x110000, dtype=np.int64)
    words, held = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), []
    for batch in batches:
        for _, _, texts in chunks(batch):
            points = lowered(texts)
            n = np.bincount(points[0])
            total[: len(n)] += n
            held.append(np.unique(Words(texts, plain=True, points=points).hashes, return_counts=True))
            if sum(len(x) for x, _ in held) > _HELD:
                words, held = _merge([words, *held]), []
                if len(words[0]) > _HELD:  # those that were seen once so far are few of any word that is frequent
                    words = tuple(x[words[1] > 1] for x in words)
    words = _merge([words, *held])
    often = np.argsort(-words[1], kind="stable")[:WRITTEN]
    found = np.flatnonzero((total > 0) & (_symbols("") > 0))
    for code, n, word in ((found, total[found], False), (words[0][often].view(np.int64), words[1][often], True)):
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n), pa.array(np.full(len(n), word))], ["code", "n", "word"])


def learned(texts: DataFrame) -> tuple[str, np.ndarray]:
    """The ALPHABET most frequent letters and digits of a column text, and about its WRITTEN most frequent words' hashes, sorted."""
    found = texts.select("text").mapInArrow(_letters, "code bigint, n bigint, word boolean").groupBy("code", "word").agg(F.sum("n").alias("n"))
    found = materialize(found, "letters", release=True)
    first = lambda word, n: found.where(F.col("word") == word).orderBy(F.desc("n"), "code").limit(n).select("code").toArrow()["code"].to_numpy()
    alphabet, words = first(False, ALPHABET), first(True, WRITTEN)
    discard(found)
    return "".join(map(chr, alphabet)) or LATIN, np.sort(words.view(np.uint64))


def learned_alphabet(texts: DataFrame) -> str:
    return learned(texts)[0]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    at = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
    return grams[at], np.add.reduceat(counts, at) if len(at) else counts


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first ^ (second << np.uint64(1)) ^ (second >> np.uint64(63))


#: Sets stems apart from words of the same characters.
_STEM = 0x5851F42D4C957F2D


def word_pairs(texts: list[str], points: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash of the word before, hash of the word, hash of its stem) for each word of each text and its end; none for wordless texts."""
    words = Words(texts, plain=True, points=points or lowered(texts))
    some = np.flatnonzero(words.counts)
    ends = words.first[1:][some]
    second = np.insert(words.hashes, ends, np.uint64(END))
    stem = summed_hashes(words.sums, words.starts, np.minimum(words.ends, words.starts + STEM)) + np.uint64(_STEM)
    stem = np.insert(stem, ends, np.uint64(END + _STEM))
    rows = np.insert(words.rows, ends, some)
    first = np.r_[np.uint64(START), second[:-1]] if len(second) else second
    first[np.r_[True, rows[1:] != rows[:-1]] if len(rows) else []] = START
    return rows, first, second, stem


def _toxic_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, part and n of the words and pairs."""
    for batch in batches:
        for _, _, texts in chunks(batch, limit=4 * CHUNK_CHARS):
            _, first, second, _ = word_pairs(texts)
            pair = (first != START) & (second != END)
            for part, keys in ((WORDS, second), (PAIRS, pair_key(first[pair], second[pair]))):
                key, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n * 2 + part)], ["key", "n"])


@dataclass
class Expressions:
    """A bitmap of the words and pairs that toxic texts have LEAST times or more, and these texts' discounts."""

    bits: np.ndarray
    discounts: list[float]


def expressions(toxic: DataFrame) -> Expressions:
    """Of the texts of the toxic class."""
    found = toxic.select("text").mapInArrow(_toxic_keys, "key bigint, n bigint")
    found = found.groupBy("key", (F.col("n") % 2).alias("part")).agg(F.sum(F.shiftright("n", 1)).alias("n"))
    slot = F.shiftrightunsigned("key", 64 - KEY_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - KEY_BITS}) & 63 as int))")
    cells = found.groupBy(F.shiftright(slot, 6).alias("cell")).agg(
        F.bit_or(F.when(F.col("n") >= LEAST, bit).otherwise(F.lit(0).cast("bigint"))).alias("bits"),
        *[F.count_if((F.col("part") == part) & (F.col("n") == n)).alias(f"n{part}{n}") for part in (PAIRS, WORDS) for n in (1, 2)],
    )
    cells = cells.toArrow()  # 2**KEY_BITS / 64 rows at most
    bits = np.zeros((1 << KEY_BITS) // 64, dtype=np.uint64)
    bits[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    one, two = ([cells[f"n{part}{n}"].to_numpy().sum() for part in (PAIRS, WORDS)] for n in (1, 2))
    return Expressions(bits, [float(a / (a + 2 * b)) if a else 0.5 for a, b in zip(one, two, strict=True)])


@cache
def _codec() -> pa.Codec:
    return pa.Codec("zstd", 1)


def _planes(*arrays: np.ndarray) -> np.ndarray:
    """Arrays of one length by byte, a row for each byte of their numbers, so that what sorted numbers share is small."""
    out, at = np.empty((sum(a.itemsize for a in arrays), len(arrays[0])), np.uint8), 0
    for a in map(np.ascontiguousarray, arrays):
        out[at : at + a.itemsize] = a.view(np.uint8).reshape(len(a), a.itemsize).T
        at += a.itemsize
    return out


def _numbers(planes: np.ndarray, *kinds: type) -> list[np.ndarray]:
    """The arrays of `_planes`."""
    out, at = [], 0
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(planes[at : at + size].T).view(k).reshape(planes.shape[1]))
        at += size
    return out


def _compressed(*planes: np.ndarray) -> bytes:
    return _codec().compress(b"".join([x.tobytes() for x in planes]), asbytes=True)


def pack_slices(slices: list[tuple[int, int]], *arrays: np.ndarray) -> list[bytes]:
    """`pack` of each slice (from, to) of the arrays."""
    planes = _planes(*arrays)
    return [(int(b) - int(a)).to_bytes(8, "little") + _compressed(planes[:, a:b]) for a, b in slices]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes."""
    return pack_slices([(0, len(arrays[0]))], *arrays)[0]


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    n, sizes = int.from_bytes(blob[:8], "little"), [np.dtype(k).itemsize for k in kinds]
    raw, out, at = np.frombuffer(_codec().decompress(blob[8:], n * sum(sizes), asbytes=True), dtype=np.uint8), [], 0
    for k, size in zip(kinds, sizes, strict=True):
        out.append((np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T) if size > 1 else raw[at : at + n]).view(k).reshape(n))
        at += n * size
    return out


def pack_runs(lead: np.ndarray, *arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes, the first one, which has its equal numbers together, by runs."""
    at = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]])
    runs = pack(lead[at], np.diff(np.r_[at, len(lead)]).astype(np.uint32))
    return len(runs).to_bytes(8, "little") + runs + pack(*arrays)


def unpack_runs(blob: bytes, kind: type, *kinds: type) -> list[np.ndarray]:
    end = 8 + int.from_bytes(blob[:8], "little")
    return [np.repeat(*unpack(blob[8:end], kind, np.uint32)), *unpack(blob[end:], *kinds)]


def pack_counted_slices(slices: list[tuple[int, int]], lead: np.ndarray, place: np.ndarray, other: np.ndarray, kind: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Counted rows as bytes, each slice (from, to): lead by runs, `other` only where it has no place in the list of words."""
    unlisted = place == WRITTEN
    rows, others = _planes(place, kind, n.astype(np.uint32)), _planes(other[unlisted])
    bounds = np.asarray(slices, dtype=np.int64).reshape(-1, 2)
    new = np.ones(len(lead), dtype=bool)
    new[1:] = lead[1:] != lead[:-1]
    new[bounds[bounds < len(lead)]] = True  # no run goes across slices
    at = np.flatnonzero(new)
    leads, sizes = _planes(lead[at]), _planes(np.diff(np.append(at, len(lead))).astype(np.uint32))
    of_run, of_other = np.searchsorted(at, bounds), np.r_[0, np.cumsum(unlisted)][bounds]
    out = []
    for (a, b), (c, d), (e, f) in zip(bounds.tolist(), of_run.tolist(), of_other.tolist(), strict=True):
        front = _compressed(rows[:, a:b], sizes[:, c:d])
        out.append(np.array([b - a, d - c, f - e, len(front)], "<u4").tobytes() + front + _compressed(leads[:, c:d], others[:, e:f]))
    return out


def pack_counted(*columns: np.ndarray) -> bytes:
    """`pack_counted_slices` of all rows."""
    return pack_counted_slices([(0, len(columns[0]))], *columns)[0]


def unpack_counted(blobs: bytes | list[bytes], words: np.ndarray) -> tuple[np.ndarray, ...]:
    """lead, other, kind, n, of one after another."""
    found: list[list[np.ndarray]] = [[], [], [], []]
    for blob in [blobs] if isinstance(blobs, bytes) else blobs:
        rows, runs, others, size = np.frombuffer(blob, "<u4", 4).tolist()
        view = memoryview(blob)
        front = np.frombuffer(_codec().decompress(view[16 : 16 + size], 7 * rows + 4 * runs, asbytes=True), np.uint8)
        back = np.frombuffer(_codec().decompress(view[16 + size :], 8 * (runs + others), asbytes=True), np.uint8)
        for x, part, height in ((found[0], front[: 7 * rows], 7), (found[1], front[7 * rows :], 4), (found[2], back[: 8 * runs], 8), (found[3], back[8 * runs :], 8)):
            x.append(part.reshape(height, -1))
    front, sizes, leads, others = (np.concatenate(x, axis=1) for x in found)
    place, kind, n = _numbers(front, np.uint16, np.uint8, np.uint32)
    lead = np.repeat(*_numbers(leads, np.uint64), *_numbers(sizes, np.uint32))
    unlisted = place == WRITTEN
    other = np.empty(len(place), dtype=np.uint64)
    other[unlisted] = _numbers(others, np.uint64)[0]
    other[~unlisted] = words[place[~unlisted]]
    return lead, other, kind, n


_PAIRS = (np.uint64, np.uint64, np.uint32, np.uint32, np.uint32, np.uint32)
_VALUES = (np.uint64, np.float32, np.float32, np.float32, np.uint32)
_ANSWERS = (np.uint32, np.float64, np.float64, np.float32)


def _buckets(lead: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(buckets, where their rows are, from and to) for sorted hashes."""
    at = np.searchsorted(lead >> np.uint64(64 - BUCKET_BITS), np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64))
    some = np.flatnonzero(np.diff(at))
    return some, list(zip(at[some].tolist(), at[some + 1].tolist(), strict=True))


def _count(alphabet: str, bits, words):
    """Words, pairs, stems, and n-grams of symbols, with their counts, summed over the task up to _HELD at a time, a row a bucket.

    bits: None, or a bitmap of the only words and pairs to count. code: the count over two bits, label and whether in the first half.
    words: `pack_counted`'s list. A bucket is the front of a word's hash, of a pair's first word's, of a stem's, and of an n-gram's last bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        list_of = Places(words.value)
        of_grams = np.zeros(CELLS << 2, dtype=np.int64)  # by n-gram and code: they are so few that a task adds them up
        may_be = (lambda keys: in_bitmap(bits.value, keys)) if bits else (lambda keys: np.ones(len(keys), dtype=bool))

        def merged(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            """key, lead, other, kind, n of each distinct key."""
            key, *rest = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = _ordered(key)
            key = key[order]
            at = _firsts(key)
            n = np.add.reduceat(rest[-1][order], at) if len(at) else rest[-1]
            return key[at], *(x[order[at]] for x in rest[:-1]), n

        def emit(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            _, lead, other, kind, n = rows
            at, listed = list_of.find(other)
            place = np.where(listed, at, WRITTEN).astype(np.uint16)
            order = _ordered(lead)
            rows = [x[order] for x in (lead, place, other, kind, n)]
            buckets, where = _buckets(rows[0])
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(pack_counted_slices(where, *rows), pa.binary())], ["bucket", "packed"])

        for batch in batches:
            codes = batch.column("code").to_numpy(zero_copy_only=False).astype(np.uint8)
            for a, b, texts in chunks(batch):
                points, code = lowered(texts), codes[a:b]
                owner, grams = ngrams(texts, alphabet, points)
                rows, first, second, stem = word_pairs(texts, points)
                np.add.at(of_grams, (grams << np.uint32(2) | code[owner]).astype(np.int64), 1)
                of_pair = np.flatnonzero((first != START) & (second != END) & may_be(pair_key(first, second)))
                of_word = np.flatnonzero(may_be(second) | (second == END))
                for lead, other, label, part in (
                    (stem, np.zeros(len(stem), np.uint64), code[rows], STEMS),
                    (second[of_word], stem[of_word], code[rows[of_word]], WORDS),
                    (first[of_pair], second[of_pair], code[rows[of_pair]], PAIRS),
                ):
                    kind = label + np.uint8(4 * part)
                    key = pair_key(lead, other) ^ (kind.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    held.append(merged([(key, lead, other, kind, np.ones(len(key), np.int64))]))
                if sum(len(x[0]) for x in held) > _HELD:
                    held = [merged(held)]
                    if len(held[0][0]) > _HELD // 2:
                        yield from emit(held[0])
                        held = []
        if held:
            yield from emit(merged(held))
        found = np.flatnonzero(of_grams)
        for a in range(0, len(found), _HELD // 2):
            some = found[a : a + _HELD // 2]
            grams = (some >> 2).astype(np.uint64)
            yield from emit((None, grams << np.uint64(64 - BUCKET_BITS), grams, (some & 3).astype(np.uint8) + np.uint8(4 * SYMBOLS), of_grams[some]))

    return run


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(bucket, its rows) of a task's rows, which are sorted by bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        of = batch.column("bucket").to_numpy()
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(of)], strict=True):
            if held and held[0].column("bucket")[0].as_py() != of[a]:
                yield held[0].column("bucket")[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column("bucket")[0].as_py(), pa.Table.from_batches(held)


_SUMS = ("ordinary", "toxic", "rest_ordinary", "rest_toxic")
_COLUMNS = (*_SUMS, "first_ordinary", "first_toxic")
#: Of a word as the first of pairs: how often these occur, and how many of them do.
_BEFORE = (*(f"before_{c}" for c in _SUMS), *(f"pairs_{c}" for c in _COLUMNS))


def _columns(sums: list[np.ndarray]) -> list[np.ndarray]:
    """The counts in _COLUMNS by those in _SUMS."""
    return [*sums, sums[0] - sums[2], sums[1] - sums[3]]


def _by_lead(lead: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Places in the order of lead, and of other (of its leading bits at least) for the same lead; equal rows are together."""
    order = np.argsort(lead)
    ranked = lead[order]
    rank = np.zeros(len(lead), dtype=np.uint64)
    rank[1:] = np.cumsum(ranked[1:] != ranked[:-1])
    width = np.uint64(max(1, len(lead).bit_length()))
    order = order[np.argsort(rank << (np.uint64(64) - width) | other[order] >> width)]
    x, y = lead[order], other[order]
    same = (x[1:] == x[:-1]) & (y[1:] >> width == y[:-1] >> width) & (y[1:] != y[:-1])
    return np.lexsort((other, lead)) if same.any() else order  # others that differ in their last bits only


def _summed(least: int, words):
    """Sums of a bucket's counts: a row for each word, stem and n-gram, and one row for all pairs, in the order of their first words.

    least: 0, or fewest occurrences of words and pairs in toxic texts. words: `pack_counted`'s list.
    """

    names = ["bucket", "first", "second", "part", *_SUMS, *_BEFORE, "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_bucket(batches):
            found = unpack_counted(rows["packed"].to_pylist(), words.value)
            parts = []
            for k in range(4):
                own = np.flatnonzero(found[2] >> 2 == k)
                lead, other, kind, n = (x[own] for x in found)
                order = _by_lead(lead, other)
                lead, other, kind, n = (x[order] for x in (lead, other, kind, n))
                at, n = _firsts(lead, other), n.astype(np.int64)
                code = kind & 3  # of ordinary texts 0 and 2, of toxic ones 1 and 3, outside the first half 0 and 1
                sums = [np.add.reduceat(np.where(of, n, 0), at) if len(at) else n for of in (code & 1 == 0, code & 1 == 1, code == 0, code == 1)]
                parts.append((lead[at], other[at], np.full(len(at), k, np.uint8), *sums))
            rare = [[int((c == m).sum()) for c in _columns(parts[k][3:]) for m in (1, 2)] for k in (PAIRS, WORDS, STEMS)]
            first = _firsts(parts[PAIRS][0])
            before = [np.add.reduceat(c, first) if len(first) else np.zeros(0, np.int64) for c in (*parts[PAIRS][3:], *((c > 0).astype(np.int64) for c in _columns(parts[PAIRS][3:])))]
            at, in_pairs = find(parts[PAIRS][0][first], parts[WORDS][0])
            before = [np.where(in_pairs, c[at], 0) if len(c) else np.zeros(len(at), np.int64) for c in before]
            lead, other, part, *sums = (np.concatenate(x) for x in zip(*parts, strict=True))
            kept = (part >= STEMS) | (sums[1] >= least) | ((part == WORDS) & (lead == END))
            pair = np.flatnonzero(kept & (part == PAIRS))
            one = np.flatnonzero(kept & (part != PAIRS))
            if len(pair):
                packed = pack_runs(lead[pair], other[pair], *(x[pair].astype(np.uint32) for x in sums))
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), none, none, pa.array([PAIRS], pa.int32()), *[none] * (len(_SUMS) + len(_BEFORE)), pa.array([packed], pa.binary())], names)
            if not least:
                none = pa.nulls(1, pa.int64())
                packed = pack(np.array(rare, np.int64).ravel())
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), none, none, pa.array([RARE], pa.int32()), *[none] * (len(_SUMS) + len(_BEFORE)), pa.array([packed], pa.binary())], names)
            kind = part[one]
            is_word = kind == WORDS
            whole = [np.zeros(len(lead), np.int64) for _ in before]
            for x, c in zip(whole, before, strict=True):
                x[part == WORDS] = c
            first = np.where(kind == WORDS, other[one], 0).view(np.int64)
            second = np.where(kind == SYMBOLS, other[one], lead[one]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(one), bucket, np.int32)), pa.array(first), pa.array(second), pa.array(kind.astype(np.int32)), *(pa.array(x[one]) for x in sums), *(pa.array(x[one], mask=~is_word) for x in whole), pa.nulls(len(one), pa.binary())],
                names,
            )

    return run


def dealt(rows: DataFrame, *order: str) -> DataFrame:
    """rows by bucket, a bucket's together, in `order`."""
    return rows.repartition("bucket").sortWithinPartitions("bucket", *order)


def _discount(counts: np.ndarray) -> float:
    one, two = (counts == 1).sum(), (counts == 2).sum()
    return float(one / (one + 2 * two)) if one else 0.5


def shared_backoff(seen: np.ndarray) -> np.ndarray:
    """Probability of the last symbol after the ORDER - 2 before it, for all 2**(5 * (ORDER - 1)) of them.

    seen: the distinct n-grams of both classes. Each order's counts are the numbers of distinct symbols
    found before an n-gram of the next.
    """
    levels, grams = [], seen
    for order in range(ORDER - 1, 0, -1):
        cells = 1 << (5 * order)
        levels.append(np.bincount(grams & (cells - 1), minlength=cells).astype(np.float64))
        grams = np.flatnonzero(levels[-1])
    p = np.full(32, 1 / 32)
    for counts in reversed(levels):
        d = _discount(counts)
        rows = counts.reshape(-1, 32)
        total = rows.sum(axis=1, keepdims=True)
        lower = np.tile(p.reshape(-1, 32), (len(rows) * 32 // len(p), 1))  # by the context without its first symbol
        rest = d * (rows > 0).sum(axis=1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            p = np.where(total > 0, (np.maximum(rows - d, 0) + rest * lower) / total, lower).reshape(-1)
    return p


def ratios(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood ratio by context for n-grams of neither class, ratio of each n-gram in `grams`).

    grams: distinct and sorted; counts: one row for the ordinary and one for the toxic class.
    """
    p = shared_backoff(grams)[grams & (CELLS // 32 - 1)]
    context = grams >> 5
    log_new, log_seen = [], []
    for c in counts:
        d = _discount(c)
        total = np.bincount(context, weights=c, minlength=CELLS // 32)
        kinds = np.bincount(context, weights=c > 0, minlength=CELLS // 32)
        with np.errstate(invalid="ignore", divide="ignore"):
            back = np.where(total > 0, d * kinds / total, 1.0)
            seen = np.where(total[context] > 0, np.maximum(c - d, 0) / total[context], 0.0) + back[context] * p
        log_new.append(np.log(back))
        log_seen.append(np.log(seen))
    return (log_new[1] - log_new[0]).astype(np.float32), (log_seen[1] - log_seen[0]).astype(np.float32)


@dataclass
class Ratios:
    """The models' log-likelihood ratios; the table over all n-grams is made once a worker."""

    key: int
    by_context: np.ndarray
    grams: np.ndarray
    values: np.ndarray
    alphabet: str

    def table(self) -> np.ndarray:
        if _tables.get("key") != self.key:
            full = np.repeat(self.by_context.astype(np.float16), 32)
            full[self.grams] = self.values
            _tables.update(key=self.key, full=full)
        return _tables["full"]


_tables: dict = {}


def measures(texts: list[str], full: np.ndarray, alphabet: str = LATIN, points: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """texts x CHARACTER_MEASURES: mean ratio of a text's symbols and of its highest stretches."""
    n = len(texts)
    owner, grams = ngrams(texts, alphabet, points)
    ratio = full[grams].astype(np.float32)
    out = np.zeros((n, len(CHARACTER_MEASURES)))
    if not len(owner):
        return out
    first = _firsts(owner)  # a text's symbols are together
    out[owner[first], 0] = np.add.reduceat(ratio, first, dtype=np.float64) / np.diff(np.append(first, len(owner)))
    starts, ends = spans((grams & 31) > 0)
    ends = np.minimum(ends + 1, len(grams))  # with the blank behind a word
    total = np.r_[0.0, np.cumsum(ratio, dtype=np.float64)]
    word_owner = owner[starts]
    words = np.bincount(word_owner, minlength=n)
    place = np.arange(len(starts)) - (np.cumsum(words) - words)[word_owner]
    for k, stretch in enumerate(STRETCHES, 1):
        # the stretch that starts at each word, as far as its text has the words; shorter texts are one stretch
        size = np.minimum(words[word_owner], stretch)
        inside = np.flatnonzero(place + size <= words[word_owner])
        last = inside + size[inside] - 1
        mean = (total[ends[last]] - total[starts[inside]]) / (ends[last] - starts[inside])
        of = word_owner[inside]
        first = _firsts(of)
        if len(first):
            out[of[first], k] = np.maximum.reduceat(mean, first)
    return out


class Places:
    """Sorted hashes, with where those of each front are: a key is found in a few steps, whatever the order of the keys."""

    def __init__(self, known: np.ndarray):
        bits = min(20, len(known).bit_length() + 2)
        self.n, self.known = len(known), np.append(known, np.uint64(2**64 - 1))
        self.shift = np.uint64(64 - bits)
        sizes = np.bincount((known >> self.shift).view(np.int64), minlength=1 << bits)
        self.start = (np.cumsum(sizes) - sizes).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each key, whether it is one of these)."""
        at = self.start[(keys >> self.shift).view(np.int64)]
        found = self.known[at]
        behind = np.flatnonzero(found < keys)
        while len(behind):
            at[behind] += 1
            found[behind] = self.known[at[behind]]
            behind = behind[found[behind] < keys[behind]]
        there = (found == keys) & (at < self.n)
        at[at == self.n] = 0
        return at, there


@dataclass
class Hot:
    """Values of the most frequent words and pairs, by sorted key."""

    keys: np.ndarray
    value: np.ndarray
    top: np.ndarray
    plus: np.ndarray


def _turned(keys: np.ndarray) -> np.ndarray:
    """The keys' second places in the bitmap of the table."""
    return keys << np.uint64(32) | keys >> np.uint64(32)


def text_keys(texts: list[str], inside: np.ndarray, points: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, which key, count) of each text's distinct words, ends, pairs and stems that may be in the table, the keys, their
    buckets, and how many words and ends each text has."""
    rows, first, second, stem = word_pairs(texts, points)
    # words are far fewer than their occurrences in a chunk, and most pairs are in no table
    at, word = _distinct(second)
    distinct = second[at]
    pair = pair_key(first, second)
    known = lambda keys: in_bitmap(inside, keys) & in_bitmap(inside, _turned(keys))
    kept = np.flatnonzero(in_bitmap(inside, pair))
    kept = kept[in_bitmap(inside, _turned(pair[kept]))]
    pair_first, pair_at = _distinct(pair[kept])
    of_word, of_stem = known(distinct), known(stem[at])
    keys = np.concatenate([distinct, stem[at], pair[kept][pair_first]])
    bucket = (np.concatenate([distinct, stem[at], first[kept][pair_first]]) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)
    some_word, some_stem = np.flatnonzero(of_word[word]), np.flatnonzero(of_stem[word])
    n, size = len(distinct), max(1, len(keys))
    row = np.concatenate([rows[some_word], rows[some_stem], rows[kept]])
    which = np.concatenate([word[some_word], n + word[some_stem], 2 * n + pair_at])
    found, times = np.unique(row * np.int64(size) + which, return_counts=True)
    row = found // size
    return row, found - row * size, times, keys, bucket, np.bincount(rows, minlength=len(texts))


def _asked(row: np.ndarray, key: np.ndarray, bucket: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, its keys and how many rows ask for each, these rows and how often) of what a block of texts asks for."""
    order = _ordered(bucket.astype(np.uint64) << np.uint64(64 - BUCKET_BITS) | key >> np.uint64(BUCKET_BITS))
    row, key, bucket, times = row[order].astype(np.uint32), key[order], bucket[order], times[order].astype(np.uint32)
    starts, runs = _firsts(bucket), _firsts(bucket, key)
    sizes, key = np.diff(np.append(runs, len(key))).astype(np.uint32), key[runs]
    edges = np.append(starts, len(bucket))
    pairs = lambda x: list(zip(x[:-1].tolist(), x[1:].tolist(), strict=True))
    yield from zip(bucket[starts].tolist(), pack_slices(pairs(np.searchsorted(runs, edges)), key, sizes), pack_slices(pairs(edges), row, times), strict=True)


def _measure(model, hot, bits, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, known, inside = model.value, hot.value, bits.value
        hot_keys = Places(known.keys)
        full = symbols.table()
        start = TaskContext.get().partitionId() << 33  # of the block
        held: list[tuple[np.ndarray, ...]] = []
        used = 0  # rows of the block that `held` is of

        def asks(like: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = list(_asked(*(np.concatenate(x) for x in zip(*held, strict=True)))) if sum(len(x[0]) for x in held) else []
            for a in range(0, len(found), 256):
                some = found[a : a + 256]
                none = lambda kind: pa.nulls(len(some), kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(none(c.type) for c in like.columns[:n]), *[none(pa.float64())] * (len(CHARACTER_MEASURES) + 4), pa.array(np.full(len(some), start)), none(pa.int32()),
                        pa.array([b for b, _, _ in some], pa.int32()), pa.array([x for _, x, _ in some], pa.binary()), pa.array([x for _, _, x in some], pa.binary()),
                    ],
                    [*like.schema.names[:n], *CHARACTER_MEASURES, "hot_sum", "hot_top", "hot_plus", "tokens", "block", "of_row", "bucket", "packed", "asking"],
                )

        for batch in batches:
            for a, b, texts in chunks(batch):
                size = b - a
                points = lowered(texts)
                x = measures(texts, full, symbols.alphabet, points)
                rows, which, times, keys, bucket, tokens = text_keys(texts, inside, points)
                at, found = (y[which] for y in hot_keys.find(keys))
                far, found = np.flatnonzero(~found), np.flatnonzero(found)
                of, at, n_times = rows[found], at[found], times[found]
                total = np.bincount(of, weights=known.value[at] * n_times, minlength=size).astype(float)  # whole numbers if there are none
                plus = np.bincount(of, weights=known.plus[at] * n_times, minlength=size).astype(float)
                top, first = np.full(size, -np.inf), _firsts(of)  # rows are in order
                if len(first):
                    top[of[first]] = np.maximum.reduceat(known.top[at], first)
                held.append((rows[far] + used, keys[which[far]], bucket[which[far]], times[far]))
                none = pa.nulls(size, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(a, size) for c in batch.columns[:n]),
                        *(pa.array(x[:, k]) for k in range(len(CHARACTER_MEASURES))),
                        *(pa.array(c) for c in (total, top, plus, tokens.astype(float))),
                        pa.array(np.full(size, start)), pa.array(np.arange(used, used + size, dtype=np.int32)), pa.nulls(size, pa.int32()), none, none,
                    ],
                    [*batch.schema.names[:n], *CHARACTER_MEASURES, "hot_sum", "hot_top", "hot_plus", "tokens", "block", "of_row", "bucket", "packed", "asking"],
                )
                used += size
                if sum(len(x[0]) for x in held) > _HELD:
                    yield from asks(batch)
                    start, used, held = start + used, 0, []
        if held:
            yield from asks(batch)

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, packed: what the keys in the task's buckets that a block of texts asks for have, summed by text. A bucket's values
    come before what asks for them."""
    held: dict[int, list[np.ndarray]] = {}  # by block: whether it has anything, total, plus and top of each text
    of, table, values, n_held = None, None, [], 0

    def grown(sums: list[np.ndarray] | None, size: int) -> list[np.ndarray]:
        """sums of `size` texts at least; twice as many as before, as blocks are asked for piece by piece."""
        have = len(sums[0]) if sums else 0
        more = max(size, 2 * have) - have
        new = [np.zeros(more, bool), np.zeros(more), np.zeros(more), np.full(more, -np.inf)]
        return [np.append(x, y) for x, y in zip(sums, new, strict=True)] if sums else new

    def emit() -> pa.RecordBatch:
        rows = [(block, np.flatnonzero(sums[0]), sums[1:]) for block, sums in held.items()]
        packed = [pack(row.astype(np.uint32), *(x[row].astype(k) for x, k in zip(sums, _ANSWERS[1:], strict=True))) for _, row, sums in rows]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in rows], pa.int64()), pa.array(packed, pa.binary())], ["block", "packed"])

    for batch in batches:
        for bucket, block, packed, asking in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "packed", "asking")), strict=True):
            if asking is None:
                of, table = bucket, unpack(packed, *_VALUES)
                values = [x.astype(np.float64) for x in table[1:4]]
                continue
            if bucket != of:  # nothing in the table is in that bucket
                continue
            keys, n = unpack(packed, np.uint64, np.uint32)
            row, times = unpack(asking, np.uint32, np.uint32)
            at, known = find(table[0], keys)
            some = np.repeat(known, n)
            at, row, times = np.repeat(at[known], n[known]), row[some], times[some]
            if not len(row):
                continue
            value, top, plus = (x[at] for x in values)
            sums, size = held.get(block), int(row.max()) + 1
            if sums is None or len(sums[0]) < size:
                n_held -= len(sums[0]) if sums else 0
                sums = held[block] = grown(sums, size)
                n_held += len(sums[0])
            sums[0][row] = True
            np.add.at(sums[1], row, value * times)
            np.add.at(sums[2], row, plus * times)
            np.maximum.at(sums[3], row, top)
            if n_held > _HELD:
                yield emit()
                held, n_held = {}, 0
    if held:
        yield emit()


def _answered(n: int):
    """The rows of blocks, whose answers come before them, with what those have added to hot_sum, hot_top and hot_plus. n: columns before the measures."""
    at = n + len(CHARACTER_MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, size = None, 0
        total, plus, top = np.zeros(0), np.zeros(0), np.zeros(0)
        for batch in batches:
            starts = _firsts(batch.column("block").to_numpy())
            for a, b in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
                own = batch.slice(a, b - a)
                if own.column("block")[0].as_py() != of:
                    of, size = own.column("block")[0].as_py(), 0
                packed = own.column("packed").drop_null().to_pylist()
                for x in packed:
                    row, *sums = unpack(x, *_ANSWERS)
                    if not len(row):
                        continue
                    if not size:
                        total, plus, top = np.zeros(0), np.zeros(0), np.zeros(0)
                    if row[-1] >= size:
                        more = int(row[-1]) + 1 - size
                        size += more
                        total, plus, top = (np.append(y, np.full(more, z)) for y, z in ((total, 0.0), (plus, 0.0), (top, -np.inf)))
                    total[row] += sums[0]  # a row once in each
                    plus[row] += sums[1]
                    top[row] = np.maximum(top[row], sums[2])
                texts = own.slice(len(packed))
                if not texts.num_rows:
                    continue
                row = texts.column("of_row").to_numpy()
                far = row < size
                row = row[far]
                hot = [texts.column(at + k).to_numpy().copy() for k in range(3)]
                if len(row):
                    hot[0][far] += total[row]
                    hot[1][far] = np.maximum(hot[1][far], top[row])
                    hot[2][far] += plus[row]
                yield pa.RecordBatch.from_arrays([*texts.columns[:at], *map(pa.array, hot), texts.column(at + 3)], texts.schema.names[: at + 4])

    return run


def labelled(documents: DataFrame, labels: DataFrame, column: str, only: int | None = None) -> DataFrame:
    """documents with their label, or with the label `only`."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    known = known.groupBy(F.col("doc_id").alias("of")).agg(F.min(F.col(column).cast("int")).alias("label"))
    known = known if only is None else known.where(F.col("label") == only)
    # labels grow with the documents, so they are never broadcast, and the plan is the same at every size;
    # a bitmap of fixed size keeps most texts without a label out of the shuffle
    some = may_match(documents, F.xxhash64("doc_id"), bitmap_cells(known, F.xxhash64("of"), ID_BITS), ID_BITS)
    return some.join(known.hint("merge"), F.col("doc_id") == F.col("of")).drop("of")


def first_half():
    """Whether a document is in the first half of the learnable ones."""
    return F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(2)) == 0


def counted(pool: DataFrame, n: int | None = None, found: Expressions | None = None, alphabet: str = LATIN, words: np.ndarray | None = None) -> DataFrame:
    """first, second, part and their counts: ordinary and toxic of all labelled documents, rest_ordinary and rest_toxic of
    those outside the first half: of every word, pair, stem and n-gram, or with `found` only of words and pairs that are these
    expressions. n, how many they are, has no say, and neither have words, which are those to be written short."""
    code = F.col("label") + F.when(first_half(), 2).otherwise(0)
    context = pool.sparkSession.sparkContext
    bits = found and context.broadcast(found.bits)
    listed = context.broadcast(np.zeros(0, np.uint64) if words is None else words)
    counts = pool.select("text", code.cast("bigint").alias("code")).mapInArrow(_count(alphabet, bits, listed), "bucket int, packed binary")
    kinds = "bucket int, first bigint, second bigint, part int, " + "".join(f"{c} bigint, " for c in (*_SUMS, *_BEFORE)) + "packed binary"
    return dealt(counts).mapInArrow(_summed(LEAST if found else 0, listed), kinds)


def symbol_model(counts: DataFrame, columns: list[str], alphabet: str) -> Ratios:
    found = counts.where((F.col("part") == SYMBOLS) & (F.col(columns[0]) + F.col(columns[1]) > 0)).select("second", *columns).toArrow()  # CELLS rows at most
    grams = found["second"].to_numpy()
    order = np.argsort(grams)
    grams, n = grams[order], np.stack([found[c].to_numpy()[order] for c in columns]).astype(np.float64)
    by_context, values = ratios(grams, n) if len(grams) else (np.zeros(CELLS // 32, np.float32), np.zeros(0, np.float32))
    return Ratios(hash((alphabet, len(grams), n.sum(), values.tobytes())), by_context, grams.astype(np.uint32), values.astype(np.float16), alphabet)


def pair_counts(columns: list[str], telling):
    """Of a packed row of pairs: first, second, and their counts in both columns, those that either has or that are telling."""

    def run(packed: bytes) -> tuple[np.ndarray, ...]:
        first, second, *sums = unpack_runs(packed, *_PAIRS)
        of = dict(zip(_COLUMNS, _columns([x.astype(np.int64) for x in sums]), strict=True))
        c0, c1 = (of[c] for c in columns)
        kept = np.flatnonzero(telling(c0, c1))
        return first[kept], second[kept], c0[kept], c1[kept]

    return run


def _of_pairs(read, what):
    """Rows that `what` (first, second, c0, c1, bucket) makes of each packed row: columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                out = what(*read(packed), bucket)
                for a in range(0, len(next(iter(out.values()))), 100_000):
                    yield pa.RecordBatch.from_pydict({k: v[a : a + 100_000] for k, v in out.items()})

    return run


def _held(d: list[float]):
    """What the pairs hold of each first word's occurrences; a first word's pairs are together."""

    def run(first, second, c0, c1, bucket):
        at = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else np.zeros(0, np.int64)
        held = [np.add.reduceat(np.maximum(c - x, 0.0), at) if len(at) else np.zeros(0) for c, x in zip((c0, c1), d, strict=True)]
        return {"word": first[at].view(np.int64), "h0": held[0], "h1": held[1]}

    return run


def find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each key in the sorted `known`, whether it is there)."""
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return at, known[at] == keys if len(known) else np.zeros(len(keys), dtype=bool)


def _valued(read, d: list[float], common):
    """Packed values of a bucket's words, stems and pairs. The bucket's rows: words and what second words of its pairs have
    that are not common, stems, and pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, p = common.value
        for bucket, rows in by_bucket(batches):
            of = rows["kind"].to_numpy()
            own, far, stem, pairs = (rows.filter(pa.array(of == k)) for k in range(4))
            parts = [[r["word"].to_numpy().view(np.uint64), *(r[c].to_numpy() for c in ("value", "top", "plus", "n"))] for r in (own, stem)]
            own, far = (r.take(np.argsort(r["word"].to_numpy().view(np.uint64))) for r in (own, far))
            left, others = (r["word"].to_numpy().view(np.uint64) for r in (own, far))
            for packed in pairs["packed"].to_pylist():
                first, second, c0, c1 = read(packed)
                at = np.searchsorted(left, first)
                n0, n1, b0, b1, context, before = (own[c].to_numpy()[at] for c in ("n0", "n1", "b0", "b1", "context", "ratio"))
                at, known = find(words, second)
                p0, p1 = np.zeros((2, len(second)))
                p0[known], p1[known] = p[at[known]].T
                at = np.searchsorted(others, second[~known])
                p0[~known], p1[~known] = (far[c].to_numpy()[at] for c in ("p0", "p1"))
                with np.errstate(invalid="ignore", divide="ignore"):
                    seen = [np.where(n > 0, np.maximum(c - x, 0.0) / n, 0.0) + b * q for n, c, x, b, q in ((n0, c0, d[0], b0, p0), (n1, c1, d[1], b1, p1))]
                full = np.log(seen[1] / seen[0])
                parts.append([pair_key(first, second), full - context - np.log(p1 / p0), full + before, np.zeros(len(first)), c0 + c1])
            values = [np.concatenate(x) for x in zip(*parts, strict=True)]
            order = np.argsort(values[0])
            packed = pack(*(x[order].astype(k) for x, k in zip(values, _VALUES, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([packed], pa.binary())], ["bucket", "packed"])

    return run


def _front(key):
    return F.shiftrightunsigned(key, 64 - BUCKET_BITS).cast("int")


def rare_counts(counts: DataFrame) -> np.ndarray:
    """Of pairs, words and stems, of each of _COLUMNS: how many are counted once, and twice."""
    found = counts.where(F.col("part") == RARE).select("packed").collect()  # a row a bucket
    return sum((unpack(r["packed"], np.int64)[0] for r in found), np.zeros(3 * len(_COLUMNS) * 2, np.int64)).reshape(3, len(_COLUMNS), 2)


def word_model(counts: DataFrame, columns: list[str], of_toxic: list[float] | None = None) -> tuple[DataFrame, float]:
    """(by bucket, packed: key, value, top, plus, n of each word, pair and stem; log-likelihood ratio of a word that no text has).

    The ratio of a word after another is the sum of the values of the word before as a context, of the word's stem, of the
    word, and of their pair. value has what a key adds to that sum, less the ratio of an unknown word for each word.
    top is the joint ratio of the word, or of the pair; plus what a stem has in favour of the toxic class.
    of_toxic: None, or the toxic texts' discounts for counts of expressions only, of which those that tell the classes apart stay.
    """
    zero = F.lit(0).cast("bigint")
    context = counts.sparkSession.sparkContext
    named = lambda prefix: [F.col(c).alias(f"{prefix}{k}") for k, c in enumerate(columns)]
    stems = counts.where((F.col("part") == STEMS) & (F.col(columns[0]) + F.col(columns[1]) > 0)).select(F.col("second").alias("stem"), *named("s"))
    if of_toxic is None:
        telling = lambda c0, c1: c0 + c1 > 0
    else:
        sizes = stems.agg(*[F.coalesce(F.sum(f"s{k}"), zero) for k in (0, 1)]).first()
        telling = lambda c0, c1: (c1 >= LEAST) & (c1 * float(sizes[0]) >= c0 * float(sizes[1]) * RATE)
    read = pair_counts(columns, telling)
    pairs = counts.where(F.col("part") == PAIRS).select("bucket", "packed")
    words = counts.where(F.col("part") == WORDS)
    told = telling(F.col(columns[0]), F.col(columns[1]))
    if of_toxic is None:
        words = words.where(told)
    else:
        both = lambda first, second, *_: {"of": np.unique(np.r_[first, second]).view(np.int64)}
        in_pairs = pairs.mapInArrow(_of_pairs(read, both), "of bigint").distinct().withColumn("in_pair", F.lit(True))
        words = words.join(in_pairs.hint("merge"), F.col("second") == F.col("of"), "left").where(told | F.col("in_pair"))
    before = [F.col(f"{of}_{c}").alias(f"{of}{k}") for of in ("before", "pairs") for k, c in enumerate(columns)] if of_toxic is None else []
    words = words.select(F.col("second").alias("word"), F.col("first").alias("stem"), *named("n"), *before)

    def discount(one: int, two: int) -> float:
        return one / (one + 2 * two) if one else 0.5

    # of a word's occurrences before another, and of a stem's, what the pairs and the words hold
    if of_toxic is None:
        rare = rare_counts(counts)
        d, e, g = ([discount(*rare[part, _COLUMNS.index(c)].tolist()) for c in columns] for part in (PAIRS, WORDS, STEMS))
        words = words.select("word", "stem", "n0", "n1", *[(F.col(f"before{k}") - d[k] * F.col(f"pairs{k}")).alias(f"h{k}") for k in (0, 1)])  # a pair has 1 at least, and d is 1 at most
    else:
        seldom = lambda df, *columns: df.agg(*[F.count_if(F.col(c) == m) for c in columns for m in (1, 2)]).first()
        few = lambda first, second, c0, c1, _: {f"n{k}{m}": [int((c == m).sum())] for k, c in enumerate((c0, c1)) for m in (1, 2)}
        of_pairs = pairs.mapInArrow(_of_pairs(read, few), "n01 bigint, n02 bigint, n11 bigint, n12 bigint").agg(*[F.coalesce(F.sum(c), zero) for c in ("n01", "n02", "n11", "n12")]).first()
        d, e = ([discount(*r[:2]), of_toxic[part]] for r, part in ((of_pairs, PAIRS), (seldom(words, "n0", "n1"), WORDS)))
        of_stems = seldom(stems, "s0", "s1")
        g = [discount(*of_stems[:2]), discount(*of_stems[2:])]
        held = pairs.mapInArrow(_of_pairs(read, _held(d)), "word bigint, h0 double, h1 double")
        words = words.join(held.hint("merge"), "word", "left")
    held = words.groupBy("stem").agg(*[F.sum(F.greatest(F.col(f"n{k}") - e[k], F.lit(0.0))).alias(f"t{k}") for k in (0, 1)], F.count(F.lit(1)).alias("t_n"))
    stems = stems.join(held.hint("merge"), "stem", "left").withColumn("types", F.coalesce("t_n", zero) + 1)
    stems = held_stems = materialize(stems, "stems", release=True)
    r = stems.agg(
        *[F.coalesce(F.sum(f"s{k}"), zero).alias(f"n{k}") for k in (0, 1)], *[F.count_if(F.col(f"s{k}") > 0).alias(f"v{k}") for k in (0, 1)], F.coalesce(F.sum("types"), zero).alias("types")
    ).first()
    back = [g[k] * r[f"v{k}"] / r[f"n{k}"] if r[f"n{k}"] else 1.0 for k in (0, 1)]
    unknown = float(np.log(back[1] / back[0]))
    of_stem = [F.greatest(F.col(f"s{k}") - g[k], F.lit(0.0)) / max(r[f"n{k}"], 1) + back[k] * F.col("types") / F.lit(float(r["types"] + 1)) for k in (0, 1)]
    left_over = lambda n, h: F.greatest(F.when(n > 0, 1 - F.coalesce(h, F.lit(0.0)) / n).otherwise(1.0), F.lit(1e-9))
    inside = [left_over(F.col(f"s{k}"), F.col(f"t{k}")) for k in (0, 1)]
    stems = stems.select("stem", "s0", "s1", "types", *[x.alias(f"{name}{k}") for name, xs in (("q", of_stem), ("i", inside)) for k, x in enumerate(xs)])
    stems = stems.withColumn("of_stem", F.log(F.col("q1") / F.col("q0"))).withColumn("of_inside", F.log(F.col("i1") / F.col("i0")))
    after = [F.when(F.col(f"s{k}") > 0, F.greatest(F.col(f"n{k}") - e[k], F.lit(0.0)) / F.col(f"s{k}")).otherwise(0.0) + F.col(f"i{k}") / F.col("types") for k in (0, 1)]
    rest = [left_over(F.col(f"n{k}"), F.col(f"h{k}")) for k in (0, 1)]
    words = words.join(stems.hint("merge"), "stem").select(
        "word", "n0", "n1", *[(F.col(f"q{k}") * x).alias(f"p{k}") for k, x in enumerate(after)], *[x.alias(f"b{k}") for k, x in enumerate(rest)],
        F.log(after[1] / after[0]).alias("of_word"), "of_inside",
    )
    words = words.withColumn("ratio", F.log(F.col("p1") / F.col("p0"))).withColumn("context", F.log(F.col("b1") / F.col("b0")))
    words = held_words = materialize(words, "words", release=True)
    # second words: the most frequent are sent to all tasks, the others to the buckets that have them
    often = materialize(words.orderBy(F.desc(F.col("n0") + F.col("n1")), "word").limit(HOT).select("word", "p0", "p1"), "often", release=True)
    frequent = often.toArrow()  # a fixed number of rows
    discard(often)
    word = frequent["word"].to_numpy().view(np.uint64)
    order = np.argsort(word)
    common = context.broadcast((word[order], np.stack([frequent[c].to_numpy()[order] for c in ("p0", "p1")], axis=1)))

    def others(first, second, c0, c1, bucket):
        far = np.unique(second)
        far = far[~find(common.value[0], far)[1]]
        return {"word": far.view(np.int64), "bucket": np.full(len(far), bucket, np.int32)}

    nothing = lambda *names: [F.lit(0.0).alias(c) for c in names]
    kind = lambda k: F.lit(k).alias("kind")
    no_pairs, names = F.lit(None).cast("binary").alias("packed"), ["bucket", "kind", "word", "n", "n0", "n1", "p0", "p1", "b0", "b1", "context", "ratio", "value", "top", "plus", "packed"]
    own = words.select(
        _front("word").alias("bucket"), kind(0), "word", (F.col("n0") + F.col("n1")).alias("n"), "n0", "n1", "p0", "p1", "b0", "b1", "context", "ratio",
        (F.col("of_word") - F.col("of_inside") + F.col("context")).alias("value"), F.col("ratio").alias("top"), *nothing("plus"), no_pairs,
    )
    of_stems = stems.select(
        _front("stem").alias("bucket"), kind(2), F.col("stem").alias("word"), (F.col("s0") + F.col("s1")).alias("n"), *[zero.alias(c) for c in ("n0", "n1")],
        *nothing("p0", "p1", "b0", "b1", "context", "ratio"), (F.col("of_stem") + F.col("of_inside") - unknown).alias("value"), F.lit(float("-inf")).alias("top"),
        F.greatest(F.col("of_stem") - MARGIN, F.lit(0.0)).alias("plus"), no_pairs,
    )

    far_words = pairs.mapInArrow(_of_pairs(read, others), "word bigint, bucket int").join(words.select("word", "p0", "p1").hint("merge"), "word")
    far_words = materialize(far_words.select("bucket", "word", "p0", "p1"), "others", release=True)

    def part(k: int) -> DataFrame:
        of = lambda df: df.where(F.col("bucket") % HALF_PARTS == k)
        far = of(far_words).select("bucket", kind(1), "word", *[zero.alias(c) for c in ("n", "n0", "n1")], "p0", "p1", *nothing("b0", "b1", "context", "ratio", "value", "top", "plus"), no_pairs)
        packed = of(pairs).select("bucket", kind(3), *[zero.alias(c) for c in ("word", "n", "n0", "n1")], *nothing(*names[6:-1]), "packed")
        rows = of(own).select(names).unionAll(far.select(names)).unionAll(of(of_stems).select(names)).unionAll(packed.select(names))
        return dealt(rows).mapInArrow(_valued(read, d, common), "bucket int, packed binary")

    values = materialize(part(0), "values", release=True, more=[part(k) for k in range(1, HALF_PARTS)])  # few rows are shuffled at a time
    common.destroy()
    discard(far_words)
    discard(held_words)
    discard(held_stems)
    return values, unknown


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, value, top, plus, n of frequent keys."""
    for batch in batches:
        for packed in batch.column("packed").to_pylist():
            key, value, top, plus, n = unpack(packed, *_VALUES)
            some = np.flatnonzero(n >= _OFTEN)
            yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), *(pa.array(x[some].astype(np.float64)) for x in (value, top, plus)), pa.array(n[some].astype(np.int64))], ["key", "value", "top", "plus", "n"])


_SLICES = 64


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of a bitmap of the task's keys and their second places."""
    bits = np.zeros(1 << KEY_BITS, dtype=bool)
    for batch in batches:
        for packed in batch.column("packed").to_pylist():
            key = unpack(packed, *_VALUES)[0]
            for x in (key, _turned(key)):
                bits[x >> np.uint64(64 - KEY_BITS)] = True
    packed = [pack(x) for x in np.packbits(bits, bitorder="little").reshape(_SLICES, -1)]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(_SLICES, dtype=np.int32)), pa.array(packed, pa.binary())], ["bucket", "packed"])


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, rows in by_bucket(batches):
        bits = None
        for x in rows["packed"]:
            (one,) = unpack(x.as_py(), np.uint8)
            bits = one if bits is None else bits | one
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["bucket", "packed"])


def known_keys(values: DataFrame) -> np.ndarray:
    """A bitmap of fixed size."""
    held = materialize(dealt(values.mapInArrow(_bits, "bucket int, packed binary")).mapInArrow(_either, "bucket int, packed binary"), "bits", release=True)
    found = held.collect()  # _SLICES rows at most
    discard(held)
    out = np.zeros((1 << KEY_BITS) // 64, dtype=np.uint64)
    for r in found:
        size = len(out) // _SLICES
        out[r["bucket"] * size : (r["bucket"] + 1) * size] = np.frombuffer(r["packed"], dtype=np.uint64)
    return out


def measured(documents: DataFrame, symbols: Ratios, values: DataFrame, unknown: float, keep: list[str], rounds: int = 1, parts: int | None = None) -> DataFrame:
    """The columns in `keep`, and MEASURES, for each row of documents.

    rounds: how many parts of the rows ask, one after another, so that few are on disk at a time; parts: how many parts of the
    table answer, one after another, `rounds` by default.
    """
    context, parts = documents.sparkSession.sparkContext, parts or rounds
    often = values.mapInArrow(_often, "key bigint, value double, top double, plus double, n bigint").orderBy(F.desc("n"), "key").limit(HOT)
    often = materialize(often.select("key", "value", "top", "plus"), "often", release=True)
    frequent = often.toArrow()  # a fixed number of rows
    discard(often)
    key = frequent["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    hot = context.broadcast(Hot(key[order], *(frequent[c].to_numpy()[order].astype(np.float32) for c in ("value", "top", "plus"))))
    bits = context.broadcast(known_keys(values))
    kept, kinds, n = carry(documents, keep)
    extra = "".join(f", {m} double" for m in [*CHARACTER_MEASURES, "hot_sum", "hot_top", "hot_plus", "tokens"])
    sent = (context.broadcast(symbols), hot, bits)
    run = _measure(*sent, n)
    no, out = F.lit(None), []
    for part in range(rounds):
        some = kept if rounds == 1 else kept.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == part)
        near = some.mapInArrow(run, f"{kinds}{extra}, block bigint, of_row int, bucket int, packed binary, asking binary")
        near = materialize(near, "ratios", release=True)
        asks = near.where("bucket IS NOT NULL").select("bucket", "block", "packed", "asking", F.lit(1).alias("kind"))
        rows = values.select("bucket", no.cast("bigint").alias("block"), "packed", no.cast("binary").alias("asking"), F.lit(0).alias("kind")).unionAll(asks)
        far = [dealt(rows.where(F.col("bucket") % parts == k), "kind").mapInArrow(_answers, "block bigint, packed binary") for k in range(parts)]
        far = [materialize(x, "far", release=True) for x in far] if parts > 1 else far  # the table is shuffled a part at a time too
        texts = near.where("bucket IS NULL").drop("bucket", "asking")
        answers = reduce(DataFrame.unionAll, far)
        answers = answers.select(*[answers[f.name] if f.name in ("block", "packed") else no.cast(f.dataType).alias(f.name) for f in texts.schema.fields])
        both = texts.unionAll(answers).repartition("block").sortWithinPartitions("block", F.col("packed").isNull())
        found = both.mapInArrow(_answered(n), f"{kinds}{extra}").select(
            *keep, *CHARACTER_MEASURES,
            F.when(F.col("tokens") > 0, F.col("hot_sum") / F.col("tokens") + unknown).otherwise(0.0).alias("word_mean"),
            F.when((F.col("tokens") > 0) & (F.col("hot_top") > float("-inf")), F.col("hot_top")).otherwise(0.0).alias("word_top"),
            F.when(F.col("tokens") > 0, F.col("hot_plus") / F.col("tokens")).otherwise(0.0).alias("stem_plus"),
        )
        out.append(materialize(found, "measured", release=True))
        for x in (near, *far):
            discard(x)
    for x in sent:
        x.destroy()
    return reduce(DataFrame.unionAll, out)


def _slopes(w: np.ndarray, mean: np.ndarray, scale: np.ndarray):
    """Of the rows of a task: gradient and second derivatives of the loss at w, as one list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h = np.zeros(len(w)), np.zeros((len(w), len(w)))
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in MEASURES], axis=1)
            z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g += z.T @ (p - batch.column("label").to_numpy(zero_copy_only=False))
            h += (z * (p * (1 - p))[:, None]).T @ z
        yield pa.RecordBatch.from_arrays([list_array(np.r_[g, h.ravel()], np.array([g.size + h.size]), pa.float64())], ["sums"])

    return run


def calibrate(seen: DataFrame, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Weights of a logistic unit on standardised measures, as weights of the measures and a constant last. seen: label, MEASURES."""
    w = np.zeros(len(mean) + 1)
    for _ in range(100):
        sums = np.sum([r["sums"] for r in seen.mapInArrow(_slopes(w, mean, scale), "sums array<double>").collect()], axis=0)  # a row a task
        step = np.linalg.solve(sums[len(w) :].reshape(len(w), -1) + 0.1 * np.eye(len(w)), sums[: len(w)] + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    plain = w[:-1] / scale
    return np.r_[plain, w[-1] - plain @ mean]


def halves(counts: DataFrame) -> DataFrame:
    """counts with first_ordinary and first_toxic: those of the first half."""
    return counts.withColumns({f"{of}first_{c}": F.col(f"{of}{c}") - F.col(f"{of}rest_{c}") for c in ("ordinary", "toxic") for of in ("", "before_")})


def score(documents: DataFrame, labels: DataFrame, keep: list[str], column: str = "toxic") -> DataFrame:
    """The columns in `keep` (doc_id among them), MEASURES and score for each row of documents."""
    with released(documents.sparkSession):
        learnable = documents.select("doc_id", "text").where(fold(F.col("doc_id")) != 0)
        pool = materialize(labelled(learnable, labels, column).select("doc_id", "text", "label"), "labelled", release=True)
        alphabet, words = learned(pool)
        counts = materialize(counted(pool, alphabet=alphabet, words=words), "counts", release=True)
        model = lambda columns: (symbol_model(halves(counts), columns, alphabet), *word_model(halves(counts), columns))
        by_half = []
        for rows, half in ((first_half(), "rest"), (~first_half(), "first")):
            symbols, values, unknown = model([f"{half}_ordinary", f"{half}_toxic"])
            by_half.append(measured(pool.where(rows), symbols, values, unknown, ["label"], parts=HALF_PARTS))
            discard(values)
        discard(pool)
        seen = by_half[0].unionByName(by_half[1])
        of = seen.agg(F.min("label"), F.max("label"), *[f(m) for f in (F.avg, F.stddev_pop) for m in MEASURES]).first()
        if of[0] is not None and of[0] < of[1]:
            mean, deviation = np.array(of[2:], dtype=float).reshape(2, -1)
            w = calibrate(seen, mean, deviation + 1e-6)
            z = sum(F.lit(float(a)) * F.col(c) for a, c in zip(w, MEASURES, strict=False)) + F.lit(float(w[-1]))
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
        else:
            p = F.lit(0.5 if of[0] is None else float(of[0]))
        symbols, values, unknown = model(["ordinary", "toxic"])
        for x in (counts, *by_half):
            discard(x)
        out = measured(documents, symbols, values, unknown, keep, ROUNDS)
        discard(values)
        return out.withColumn("score", p)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
