"""WARC archives: written with revisit records for equal payloads, read back by boundary-chain verification.

Writing: payloads of at least MIN_REVISIT bytes are grouped by digest. Only digests that occur twice meet
the pages again in a join, so unequal pages are written from the scan without a shuffle of their text.
Spark's text writer makes the files, with its commit protocol, in any file system that Spark can write to.

Reading: a split-wise scan cuts the files at the magic string. Every piece is a candidate record; its
header tells the offset of its successor. A candidate is a record only if the chain of successors from
its file's start reaches it, so magic strings inside payloads are rejected. Candidates that follow each
other without a gap form runs, which enter and leave the chain as one node; pointer jumping doubles the
steps along the runs, in as many rounds as the logarithm of a file's number of runs.
Payloads that hold the magic string are put together again from their pieces in a second scan, which
takes place only if there are any.

Defined cases: null html is an empty payload, always a response; a null url leaves the header out; a null
page_id is read back as null and refers to the group's largest page_id, or is a response if there is none;
rows that repeat the largest page_id are all responses; an archive that does not begin with a record has
none; a record that runs past its file's end is dropped; no archives or pages give no rows; very long payloads are written and
digested whole, and a worker holds the longest one; rows with equal ids below the largest all revisit it; extra columns of pages
have no say, whatever their names. Only records of WARC/1.0, as they are written here, are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reprise.llm.common import materialize, new_path, table

MAGIC = "WARC/1.0\r\n"
MIN_REVISIT = 1000
RECORDS_PER_FILE = 50_000
DATE = "2024-01-01T00:00:00Z"
_ID = "urn:reprise:page:"


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str) -> None:
    """pages: page_id, url, html. One record a row."""
    data = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", data.alias("html"),
        F.octet_length(data).cast("bigint").alias("bytes"), F.sha1(data.cast("binary")).alias("digest"),
    )
    groups = (
        pages.where(F.col("bytes") >= MIN_REVISIT)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("first"))
        .where("copies > 1 AND first IS NOT NULL")
        .select(F.col("digest").alias("of"), "first")
    )
    # written first, so that its size is known before the join is planned
    groups = materialize(groups, "copies")
    typed = pages.join(groups, (F.col("digest") == F.col("of")) & (F.col("bytes") >= MIN_REVISIT), "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    record = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit(f"WARC-Record-ID: <{_ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\n")),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        _line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "%20")),
        F.when(revisit, F.concat(F.lit(f"WARC-Refers-To: <{_ID}"), F.col("first").cast("string"), F.lit(">\r\n"))).otherwise(""),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n")),
        F.concat(F.lit("X-Payload-Bytes: "), F.col("bytes").cast("string"), F.lit("\r\n")),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")),
        body,
        F.lit("\r\n\r"),  # the writer's line end completes it
    )
    typed.select(record.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_PIECE = "file string, block bigint, ord bigint, rel bigint, len bigint, head int, body bigint, header binary, sha1 string"
_FIELD = re.compile(rb"(?im)^([\w-]+):[ \t]*(.*?)[ \t]*\r?$")


def _scan(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(
        F.col("value").cast("binary").alias("data"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def _header(data: bytes) -> tuple[int, int]:
    """Bytes of the header with its empty line, and the declared content length; -1 if there is none."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return 0, -1
    length = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})[ \t]*\r?$", data[: end + 2])
    return end + 4, int(length[1]) if length else -1


def _pieces(raw: bool):
    """Numbers the pieces of each file block and measures them; raw: hands their bytes on instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, count, rel = None, 0, 0
        for batch in batches:
            rows = []
            for data, file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (file, block):
                    at, count, rel = (file, block), 0, 0
                if raw:
                    rows.append((file, block, count, data))
                else:
                    head, body = _header(data)
                    whole = body >= 0 and head + body <= len(data)
                    digest = hashlib.sha1(memoryview(data)[head : head + body]).hexdigest() if whole else None
                    rows.append((file, block, count, rel, len(data), head, body, data[: max(0, head - 2)], digest))
                count += 1
                rel += len(data) + len(MAGIC)
            if not rows:
                continue
            columns = list(zip(*rows, strict=True))
            if raw:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
                names = ["file", "block", "ord", "data"]
            else:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
                names = [x.split()[0] for x in _PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _reached(nodes: DataFrame) -> DataFrame:
    """nodes: file, off, next -> file, off of those that the chain from offset 0 reaches."""
    by_file = W.partitionBy("file").orderBy("off")
    broken = F.when(F.lag("next").over(by_file) == F.col("off"), 0).otherwise(1)
    nodes = nodes.withColumn("new", broken).withColumn("run", F.sum("new").over(by_file)).drop("new")
    nodes = materialize(nodes, "nodes")
    runs = nodes.groupBy("file", "run").agg(F.min("off").alias("start"), F.max_by("next", "off").alias("exit"))
    into = nodes.select("file", F.col("off").alias("exit"), F.col("run").alias("to"))
    runs = materialize(runs.join(into, ["file", "exit"], "left"), "runs")
    most = runs.agg(F.max("run")).first()[0] or 0
    reached = runs.where("start = 0").select("file", "run")
    jump = runs.where("to IS NOT NULL").select("file", "run", "to")
    for _ in range(math.ceil(math.log2(most)) if most > 1 else 0):
        ahead = reached.join(jump, ["file", "run"]).select("file", F.col("to").alias("run"))
        reached = materialize(reached.union(ahead).distinct(), "reached")
        onward = jump.select("file", F.col("run").alias("to"), F.col("to").alias("then"))
        jump = materialize(jump.join(onward, ["file", "to"]).select("file", "run", F.col("then").alias("to")), "jump")
    left = runs.join(reached, ["file", "run"], "left_semi")
    entries = (
        left.where("start = 0").select("file", "run", F.lit(0).cast("bigint").alias("entry"))
        .union(left.where("to IS NOT NULL").select("file", F.col("to").alias("run"), F.col("exit").alias("entry")))
        .groupBy("file", "run").agg(F.min("entry").alias("entry"))
    )
    return nodes.join(entries, ["file", "run"]).where("off >= entry").select("file", "off")


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for file, off, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = MAGIC.encode().join(p["data"] for p in sorted(parts, key=lambda p: p["part"]))
            head, body = _header(data)
            out.append((file, off, hashlib.sha1(data[head : head + body]).hexdigest() if head + body <= len(data) else None))
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int64(), pa.string()], strict=True)], ["file", "off", "whole"])


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["warc-type", "warc-record-id", "warc-target-uri", "warc-refers-to", "warc-payload-digest", "x-payload-bytes"]
    for batch in batches:
        rows = []
        for header in batch.column("header").to_pylist():
            found = {k.lower().decode("latin-1"): v.decode("utf-8", "replace") for k, v in _FIELD.findall(header)}
            rows.append([found.get(n) for n in names])
        columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))]
        keep = [batch.column(c) for c in ("file", "off", "body", "sha1")]
        yield pa.RecordBatch.from_arrays([*keep, *columns], ["file", "offset", "content_length", "sha1", "type", "record_id", "target_uri", "refers_to", "digest", "bytes"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, content_length, sha1 (hex, of the content as read), type, record_id, target_uri, refers_to, digest, bytes."""
    pieces = materialize(_scan(spark, path).mapInArrow(_pieces(False), _PIECE), "pieces")
    step = F.lit(len(MAGIC))
    blocks = pieces.groupBy("file", "block").agg(F.max(F.col("rel") + F.col("len") + step).alias("total"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # the piece before a file's first magic has offset -10 and is no candidate
    placed = pieces.join(blocks, ["file", "block"]).withColumn("off", F.col("base") + F.col("rel") - step)
    ends = F.col("off") + step + F.col("head") + F.col("body") + 4
    nodes = placed.where("off >= 0").select("file", "off", F.when(F.col("body") >= 0, ends).alias("next"))
    reached = materialize(_reached(nodes), "chain").withColumn("is_record", F.lit(True))
    placed = placed.join(reached, ["file", "off"], "left")
    records = placed.where("is_record AND body >= 0")
    long = records.where("sha1 IS NULL")
    if long.limit(1).count():
        owner = F.last(F.when(F.col("is_record"), F.col("off")), True).over(W.partitionBy("file").orderBy("off"))
        owned = placed.select("file", "block", "ord", "off", owner.alias("owner"))
        owned = owned.join(long.select("file", F.col("off").alias("owner")), ["file", "owner"], "left_semi")
        raw = _scan(spark, path).mapInArrow(_pieces(True), "file string, block bigint, ord bigint, data binary")
        whole = (
            raw.join(owned, ["file", "block", "ord"])
            .groupBy("file", F.col("owner").alias("off"))
            .agg(F.collect_list(F.struct(F.col("off").alias("part"), "data")).alias("parts"))
            .mapInArrow(_join_pieces, "file string, off bigint, whole string")
        )
        records = records.join(whole, ["file", "off"], "left").withColumn("sha1", F.coalesce("sha1", "whole"))
    kinds = "file string, offset bigint, content_length bigint, sha1 string, type string, record_id string, target_uri string, refers_to string, digest string, bytes string"
    return records.where("sha1 IS NOT NULL").select("file", "off", "body", "sha1", "header").mapInArrow(_fields, kinds)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    records = read_archives(spark, path)
    revisit = F.col("type") == "revisit"
    page = lambda c: F.regexp_extract(c, rf"<{_ID}(-?\d+)>", 1).try_cast("bigint")
    return records.select(
        page("record_id").alias("page_id"),
        F.when(revisit, F.col("bytes").try_cast("bigint")).otherwise(F.col("content_length")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("digest", "^sha1:", "")).otherwise(F.col("sha1")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(revisit, page("refers_to")).alias("refers_to"),
    )


OP9_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h, n >= 1000) END AS top FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM g
"""
