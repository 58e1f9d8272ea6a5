"""N-gram Jaccard join: near-duplicate texts by MinHash banding, verified on whole n-gram sets.

Exact copies are folded into one representative before anything is joined. A representative's signature
is cut into bands; band and row counts are the narrowest that reach the target recall at the threshold.
Representatives are shuffled on band hashes, and each bucket gives a star of links to its smallest member,
never its pairs. The stars' connected components are candidate clusters.

Verification takes every pair within a cluster, so it loses nothing that banding brought together, on the
full sets of n-gram hashes. A cluster is dealt into blocks of bounded size and each task compares one pair
of blocks, so a cluster of any size is spread over many tasks. A task hands on, for each member, the
number of its links and one link to the smallest member that it is connected to, never the pairs.

Only texts that may be a cluster's members are shuffled: a bitmap of fixed size over the members keeps most others back.

Defined cases: a text with fewer than `size` words is one n-gram of all its words; null, empty and wordless texts
have no n-grams and are linked to nothing; very long texts are compared whole, and a worker holds the longest one; repeated rows
are copies; ties between ids of a class go to the smallest, and between texts of one id to the smallest key; a null doc_id takes
part like any other and is never chosen as a class id unless all ids of its class are null; an empty table gives no rows; extra
columns have no say, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.llm.common import Words, bitmap_cells, chunks, list_array, materialize, may_match, mix, shingles, table

SIZE = 5
SIMILARITY = 0.8
RECALL = 0.9995
MAX_HASHES = 160
#: A block has about so many n-grams and documents at most.
BLOCK_GRAMS = 1_000_000
BLOCK_DOCS = 2048
#: N-grams in more of a task's documents than this are counted by matrix product, others pair by pair.
DENSE = 64
MEMBER_BITS = 25
STRIPE = 256


def banding(similarity: float = SIMILARITY, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which enough bands for the recall fit into max_hashes."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        hit = similarity**rows
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit))) if hit < 1 else 1
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


@cache
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1), h.astype(np.uint32)


def band_hashes(grams: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For each run of `grams` that begins at `starts`, a hash of each band of its signature."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    mul, add = _multipliers(bands * rows)
    out, y = np.empty((len(starts), bands), dtype=np.uint64), np.empty_like(x)
    for band in range(bands):
        h = np.full(len(starts), band + 1, dtype=np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            np.multiply(x, mul[k], out=y)
            np.bitwise_xor(y, add[k], out=y)
            h = h * np.uint64(0xBF58476D1CE4E5B9) + np.minimum.reduceat(y, starts)
        out[:, band] = mix(h)
    return out


def _signatures(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch):
                n = b - a
                owner, grams = shingles(Words(texts), size)
                order = np.argsort(owner, kind="stable")
                owner, grams = owner[order], grams[order]
                have, starts = np.unique(owner, return_index=True)
                count = np.zeros(n, dtype=np.int64)
                hashes = np.zeros((0, bands), dtype=np.uint64)
                if len(have):
                    pairs = np.lexsort((grams, owner))
                    o, g = owner[pairs], grams[pairs]
                    new = np.ones(len(o), dtype=bool)
                    new[1:] = (o[1:] != o[:-1]) | (g[1:] != g[:-1])
                    count = np.bincount(o[new], minlength=n)
                    hashes = band_hashes(grams, starts, bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, n),
                        batch.column("text_key").slice(a, n),
                        pa.array(count, pa.int64()),
                        list_array(hashes.reshape(-1).view(np.int64), np.where(count > 0, bands, 0), pa.int64()),
                    ],
                    ["doc_id", "text_key", "grams", "bands"],
                )

    return run


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a, b), both bigint: node, root (the smallest node), for nodes with edges.

    Alternating large-star and small-star steps (Kiveris et al. 2014) until the edges no longer change.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = materialize(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), name)
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    state = mark(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        small = small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        edges = materialize(small, name)
        before, state = state, mark(edges)
        if before == state:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _sets(size: int):
    """Each member's set of n-gram hashes, once for every pair of blocks that its block is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # repeated rows of a representative mostly come one after the other
        for batch in batches:
            meta = [batch.column(c).to_numpy() for c in ("cluster", "node", "copies", "block", "blocks")]
            for a, b, texts in chunks(batch):
                owner, grams = shingles(Words(texts), size)
                order = np.lexsort((grams, owner))
                owner, grams = owner[order], grams[order]
                new = np.ones(len(owner), dtype=bool)
                new[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
                grams, ends = grams[new], np.cumsum(np.bincount(owner[new], minlength=b - a))
                for i in range(b - a):
                    cluster, node, copies, block, blocks = (int(m[a + i]) for m in meta)
                    if node == last:
                        continue
                    last = node
                    others = np.arange(blocks)
                    own = grams[ends[i - 1] if i else 0 : ends[i]].view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(blocks, cluster)),
                            pa.array(np.minimum(others, block)),
                            pa.array(np.maximum(others, block)),
                            pa.array(np.full(blocks, block)),
                            pa.array(np.full(blocks, node)),
                            pa.array(np.full(blocks, copies)),
                            list_array(np.tile(own, blocks), np.full(blocks, len(own)), pa.int64()),
                        ],
                        ["cluster", "i", "j", "block", "node", "copies", "grams"],
                    )

    return run


def shared_counts(grams: np.ndarray, owner: np.ndarray, n: int, split: int) -> np.ndarray:
    """Common n-grams of every document before `split` with every one from it on; of all pairs if split is n.

    grams: the documents' sets one after the other; owner: the document of each.
    """
    left, right, shift = (n, n, 0) if split == n else (split, n - split, split)
    out = np.zeros((left, right), dtype=np.float32)
    order = np.lexsort((owner, grams))
    g, o = grams[order], owner[order]
    at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.r_[at, len(g)])
    for d in np.unique(count[(count > 1) & (count <= DENSE)]):
        first = at[count == d]
        step = max(1, 4_000_000 // (int(d) * int(d)))
        x, y = np.triu_indices(int(d), 1)
        for s in range(0, len(first), step):
            own = o[first[s : s + step, None] + np.arange(d)]
            p, q = own[:, x].ravel(), own[:, y].ravel() - shift
            if shift:
                cross = (p < split) & (q >= 0)
                p, q = p[cross], q[cross]
            np.add.at(out.reshape(-1), p * right + q, np.float32(1))
    many = count > DENSE
    if many.any():
        column = np.repeat(np.where(many, np.cumsum(many) - 1, -1), count)
        o, column = o[column >= 0], column[column >= 0]
        for s in range(0, int(many.sum()), 1024):
            part = (column >= s) & (column < s + 1024)
            x = np.zeros((n, 1024), dtype=np.float32)
            x[o[part], column[part] - s] = 1
            out += x[:left] @ x[shift:].T
    return out


def verify(grams: np.ndarray, sizes: np.ndarray, copies: np.ndarray, split: int, similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """For each document: how many documents it is linked to, and the first document of its component."""
    n = len(sizes)
    common = shared_counts(grams, np.repeat(np.arange(n), sizes), n, split)
    left, shift = len(common), 0 if split == n else split
    p, q = similarity.numerator, similarity.denominator
    near = np.empty(common.shape, dtype=bool)
    links = np.zeros(n, dtype=np.int64)
    stripes = [slice(i, min(i + STRIPE, left)) for i in range(0, left, STRIPE)]  # bounds what is held besides counts
    for rows in stripes:
        near[rows] = common[rows].astype(np.float64) * (p + q) >= p * (sizes[rows, None] + sizes[None, shift:])
        if not shift:
            near[rows] &= np.arange(left)[None, :] > np.arange(left)[rows, None]
        links[rows] += near[rows] @ copies[shift:]
        links[shift:] += copies[rows] @ near[rows]
    del common
    root = np.arange(n)
    while True:
        new = root.copy()
        for rows in stripes:
            new[rows] = np.minimum(new[rows], np.where(near[rows], root[None, shift:], n).min(axis=1, initial=n))
        for rows in stripes:
            new[shift:] = np.minimum(new[shift:], np.where(near[rows], new[rows, None], n).min(axis=0, initial=n))
        new = new[new]
        if (new == root).all():
            return links, root
        root = new


def _verify(similarity: Fraction):
    def group(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        block, node, copies = (t[c].to_numpy() for c in ("block", "node", "copies"))
        _, once = np.unique(node, return_index=True)
        order = once[np.argsort(block[once], kind="stable")]
        t = t.take(pa.array(order))
        grams = t["grams"].combine_chunks()
        sizes = np.diff(grams.offsets.to_numpy())
        split = len(order) if i == j else int((block == i).sum())
        if i != j and split in (0, len(order)):  # one of the blocks has no members
            links, root = np.zeros(len(order), dtype=np.int64), np.arange(len(order))
        else:
            links, root = verify(grams.flatten().to_numpy().view(np.uint64), sizes, copies[order], split, similarity)
        node = node[order]
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(node[root])], ["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("cluster", "i", "j")], axis=1)
            if not len(keys):
                continue
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(keys)], strict=True):
                if held and tuple(keys[a]) != key:
                    yield group(held)
                    held = []
                key = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield group(held)

    return run


def text_key(column: str = "text"):
    """16 bytes that stand for a text; null for null."""
    return F.unhex(F.md5(F.col(column).cast("binary")))


def jaccard_classes(documents: DataFrame, similarity: float = SIMILARITY, size: int = SIZE, recall: float = RECALL) -> DataFrame:
    """doc_id, text_key, class_id, class_text, links, grams for each row of documents (doc_id, text).

    class_id: the smallest doc_id among the documents that links connect, and class_text the smallest
    text_key of its texts; links: how many other documents have the similarity or more, copies included.
    """
    bands, rows = banding(similarity, recall)
    id_type = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select("doc_id", text_key().alias("text_key"), "text")
    signed = docs.select("doc_id", "text_key", "text").mapInArrow(
        _signatures(size, bands, rows), f"doc_id {id_type}, text_key binary, grams bigint, bands array<bigint>"
    )
    signed = materialize(signed, "signatures")
    nodes = signed.where("grams > 0").groupBy("text_key").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands")
    )
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    banded = nodes.select("node", F.posexplode("bands").alias("band", "hash"))
    buckets = banded.groupBy("band", "hash").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = banded.join(buckets, ["band", "hash"]).select(F.col("node").alias("a"), F.col("least").alias("b"))
    clusters = components(stars, "clusters").withColumnRenamed("root", "cluster")
    clusters = nodes.drop("bands").join(clusters, "node")
    totals = clusters.groupBy("cluster").agg(
        F.greatest(F.ceil(F.sum("grams") / BLOCK_GRAMS), F.ceil(F.count(F.lit(1)) / BLOCK_DOCS)).cast("bigint").alias("blocks")
    )
    members = clusters.join(totals, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    members = materialize(members, "members")
    cells = bitmap_cells(members, F.xxhash64("text_key"), MEMBER_BITS)
    texts = (
        may_match(docs, F.xxhash64("text_key"), cells, MEMBER_BITS).join(
            members.select(F.col("text_key").alias("of"), "first_id", "cluster", "node", "copies", "block", "blocks"),
            (F.col("text_key") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id")),
        )
        .select("cluster", "node", "copies", "block", "blocks", "text")
        .mapInArrow(_sets(size), "cluster bigint, i bigint, j bigint, block bigint, node bigint, copies bigint, grams array<bigint>")
    )
    found = (
        texts.repartition("cluster", "i", "j")
        .sortWithinPartitions("cluster", "i", "j", "node")
        .mapInArrow(_verify(Fraction(similarity).limit_denominator(10_000)), "node bigint, links bigint, root bigint")
    )
    found = materialize(found, "links")
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "classes")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("text_key", "node", "copies", "first_id").join(links, "node", "left").join(classes, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "text_key")).alias("least"))
    named = named.join(least, "root").select(
        F.col("text_key").alias("of"), F.col("least.first_id").alias("class_id"), F.col("least.text_key").alias("class_text"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    out = signed.select("doc_id", "text_key", "grams").join(named, (F.col("text_key") == F.col("of")) & (F.col("grams") > 0), "left")
    own = lambda mine, of_class: F.when(F.col("of").isNull(), F.col(mine)).otherwise(F.col(of_class)).alias(of_class)
    return out.select("doc_id", "text_key", own("doc_id", "class_id"), own("text_key", "class_text"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), "grams")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", F.col("links").alias("n_links"))
