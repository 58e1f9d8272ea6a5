"""The document table: upserts, deletions, changed documents and change lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reprise.functions.text import apply_edits


def latest(events: DataFrame, order: str = "version") -> DataFrame:
    """The last event of each uri; events without a text delete."""
    return events.groupBy("uri").agg(F.max_by(F.struct(*events.columns), order).alias("e")).select("e.*")


def upsert(documents: DataFrame, events: DataFrame, order: str = "version") -> DataFrame:
    """documents (uri, text) after events (uri, text or null, version)."""
    last = latest(events, order)
    kept = documents.join(last.select("uri"), "uri", "left_anti")
    return kept.select("uri", "text").unionByName(last.where(F.col("text").isNotNull()).select("uri", "text"))


def edited(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """documents (uri, text) after ranged edits (uri, version, start_line, start_char, end_line, end_char, text),
    each document's in the order of their versions; edits of unknown documents are left out."""
    names = ("start_line", "start_char", "end_line", "end_char", "text")
    listed = edits.groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("version", *names))).alias("edits"))
    joined = documents.select("uri", "text").join(listed, "uri", "left")
    return joined.select("uri", apply_edits(F.col("text"), F.col("edits")).alias("text"))


def folded(documents: DataFrame, events: DataFrame) -> DataFrame:
    """documents (uri, text) after events (uri, text, version, edits), each document's in the order of their versions.

    An event has a whole text, or ranged edits of the text so far, each on the result of the one before, or neither: it deletes.
    Edits of documents that are not there are left out.
    """
    listed = events.groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("version", "text", "edits"))).alias("events"))
    one = lambda so_far, e: F.when(e["edits"].isNull(), e["text"]).otherwise(apply_edits(so_far, e["edits"]))
    both = documents.select("uri", F.col("text").alias("was")).join(listed, "uri", "full")
    now = F.when(F.col("events").isNull(), F.col("was")).otherwise(F.aggregate("events", F.col("was"), one))
    return both.select("uri", now.alias("text")).where(F.col("text").isNotNull())


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """uri, change: added, modified or deleted between two versions of documents (uri, text).

    Texts are compared by two hashes, so only numbers are shuffled.
    """
    hashed = lambda df, c: df.select("uri", F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")).alias(c))
    both = hashed(old, "was").join(hashed(new, "is"), "uri", "full")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("was") != F.col("is"), "modified")
    return both.select("uri", kind.alias("change")).where("change IS NOT NULL")


def change_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """op, path of the lines `M "path"`, `A "path"`, `D "path"`; other lines are left out."""
    pattern = r'^([MAD]) "(.*)"$'
    out = lines.select(*[c for c in lines.columns if c != column], F.regexp_extract(column, pattern, 1).alias("op"), F.regexp_extract(column, pattern, 2).alias("path"))
    return out.where("op <> ''")


def minimized(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """Of versions (version, path, text) the first one whole, and of the others what their change list names."""
    first = versions.agg(F.min("version").alias("first"))
    named = versions.join(changes.select("version", "path").distinct(), ["version", "path"], "left_semi")
    # one row
    whole = versions.join(F.broadcast(first), F.col("version") == F.col("first"), "left_semi")
    return whole.unionByName(named.join(F.broadcast(first), F.col("version") == F.col("first"), "left_anti"))


def reversed_versions(versions: DataFrame) -> DataFrame:
    """The versions' names in opposite order: the first one's files become the last one's."""
    names = versions.select("version").distinct()  # as many rows as versions
    numbered = names.withColumn("up", F.row_number().over(W.orderBy("version"))).withColumn("down", F.row_number().over(W.orderBy(F.col("version").desc())))
    pairs = numbered.alias("a").join(numbered.alias("b"), F.col("a.up") == F.col("b.down")).select(F.col("a.version"), F.col("b.version").alias("becomes"))
    return versions.join(pairs, "version").drop("version").withColumnRenamed("becomes", "version")


def sample_fragments(fragments: DataFrame, least: int, most: int, count: int, salt: str = "") -> DataFrame:
    """`count` documents in the order of a hash of their uri, of each the first fragment of a fitting size."""
    fit = fragments.where(F.size("toks").between(least, most))
    first = fit.groupBy("uri").agg(F.min("frag_id").alias("frag_id"))
    return first.withColumn("place", F.md5(F.concat(F.lit(salt), F.col("uri")).cast("binary"))).orderBy("place", "uri").limit(count)


def deletions_per_version(first: int, versions: int, step: int = 5) -> list[int]:
    """How many fragments each version after the first deletes: up to the next multiple of `step` each time."""
    out, n = [], first
    for _ in range(1, versions):
        out.append(n)
        n = n + step - n % step
    return out
