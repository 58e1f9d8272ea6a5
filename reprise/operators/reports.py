"""What becomes of clones: per-document lists, diagnostics, pairs, reports, ranges and jump targets.

Ranged clones have uri, start_line, start_char, end_line, end_char, clone_size and class_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reprise.functions.text import file_name, folder_name

RANGE = ("start_line", "start_char", "end_line", "end_char")
SEVERITY = "Information"


def range_text(prefix: str = "") -> Column:
    at = lambda c: F.col(prefix + c).cast("string")
    return F.concat(at("start_line"), F.lit(":"), at("start_char"), F.lit("-"), at("end_line"), F.lit(":"), at("end_char"))


def with_match_count(ranged: DataFrame) -> DataFrame:
    counts = ranged.groupBy("class_id").agg((F.count(F.lit(1)) - 1).alias("n_matches"))
    return ranged.join(counts, "class_id")


def clones_per_document(documents: DataFrame, ranged: DataFrame) -> DataFrame:
    """uri, n_clones, n_tokens: every document, those without clones too."""
    per = ranged.groupBy("uri").agg(F.count(F.lit(1)).alias("n_clones"), F.sum(F.col("clone_size") + 1).alias("n_tokens"))
    zero = F.lit(0).cast("bigint")
    return documents.select("uri").join(per, "uri", "left").select("uri", F.coalesce("n_clones", zero).alias("n_clones"), F.coalesce("n_tokens", zero).alias("n_tokens"))


def diagnostics(ranged: DataFrame) -> DataFrame:
    """uri, range, message, severity, n_related for each clone; where the related ones are is in `related_locations`."""
    counted = with_match_count(ranged)
    return counted.select(
        "uri", range_text().alias("range"), F.concat(F.col("n_matches").cast("string"), F.lit(" clone(s) detected")).alias("message"),
        F.lit(SEVERITY).alias("severity"), F.col("n_matches").alias("n_related"),
    )


def related_locations(ranged: DataFrame) -> DataFrame:
    """class_id, uri, range, message of every clone, once. The related locations of a diagnostic are the other rows of its class:
    in this form they grow with the clones, and not with the square of a class."""
    return ranged.select("class_id", "uri", range_text().alias("range"), F.concat(F.lit("Matching clone in "), file_name(F.col("uri"))).alias("message"))


def related(ranged: DataFrame, uris: DataFrame) -> DataFrame:
    """uri, range, and related_uri, related_range, message of the other clones of its class, for the clones of the documents in uris
    (those that are published now)."""
    at = related_locations(ranged)
    here = at.join(uris.select("uri").distinct(), "uri", "left_semi").select("class_id", "uri", "range")
    there = at.select("class_id", F.col("uri").alias("related_uri"), F.col("range").alias("related_range"), "message")
    return here.join(there, "class_id").where("uri <> related_uri OR range <> related_range").drop("class_id")


def published(documents: DataFrame, ranged: DataFrame) -> DataFrame:
    """uri, diagnostics (array, ordered by range): what is sent for each document, an empty array without clones."""
    listed = diagnostics(ranged).groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("range", "message", "severity", "n_related"))).alias("diagnostics"))
    return documents.select("uri").join(listed, "uri", "left").withColumn("diagnostics", F.coalesce("diagnostics", F.array().cast(listed.schema["diagnostics"].dataType)))


def pairs(ranged: DataFrame) -> DataFrame:
    """Both directions of every pair of clones of a class with different ranges: folder, file, first and last
    line from 1, and the same of the match."""
    side = ranged.select(
        "class_id", folder_name(F.col("uri")).alias("folder"), file_name(F.col("uri")).alias("file"),
        (F.col("start_line") + 1).alias("first_line"), (F.col("end_line") + 1).alias("last_line"), F.struct("uri", *RANGE).alias("at"),
    )
    names = ["folder", "file", "first_line", "last_line"]
    other = side.select("class_id", *[F.col(c).alias(f"match_{c}") for c in names], F.col("at").alias("match_at"))
    return side.join(other, "class_id").where("at <> match_at").select(*names, *[f"match_{c}" for c in names])


def write_pairs(ranged: DataFrame, path: str) -> None:
    """The pairs as CSV without a header."""
    pairs(ranged).write.csv(path)


def report(ranged: DataFrame) -> DataFrame:
    """line: a text for each clone."""
    return with_match_count(ranged).select(F.concat(F.lit("CodeClone("), "uri", F.lit("\n"), range_text(), F.lit("\nMatches: "), F.col("n_matches").cast("string"), F.lit(")")).alias("line"))


def summary(ranged: DataFrame) -> DataFrame:
    """One row: n_clones, n_classes, n_documents, largest (in tokens)."""
    sizes = F.coalesce(F.max(F.col("clone_size") + 1), F.lit(0))
    classes = ranged.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.max("clone_size").alias("clone_size"))
    documents = ranged.select("uri").distinct().agg(F.count(F.lit(1)).alias("n_documents"))
    totals = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_clones"), F.count(F.lit(1)).alias("n_classes"), sizes.cast("bigint").alias("largest"))
    return totals.crossJoin(documents)  # one row each


def at_range(ranged: DataFrame, uri: str, start_line: int, end_line: int) -> DataFrame:
    """The clones of a document that enclose the lines; characters have no say."""
    return ranged.where((F.col("uri") == uri) & (F.col("start_line") <= start_line) & (F.col("end_line") >= end_line))


def requested(ranged: DataFrame, requests: DataFrame) -> DataFrame:
    """The same for a table of requests (uri, from_line, to_line)."""
    return ranged.join(requests, "uri").where("start_line <= from_line AND end_line >= to_line")


def jump_targets(ranged: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request and enclosing clone, every other clone of its class: title, command and its arguments."""
    here = requested(ranged, requests).select("class_id", F.col("uri").alias("from_uri"), "from_line", "to_line", F.struct("uri", *RANGE).alias("here"))
    there = ranged.select("class_id", "uri", *RANGE, F.struct("uri", *RANGE).alias("there"))
    point = lambda a, b: F.struct(F.col(a).alias("line"), F.col(b).alias("character"))
    json = F.to_json(F.struct(point("start_line", "start_char").alias("start"), point("end_line", "end_char").alias("end")))
    return here.join(there, "class_id").where("here <> there").select(
        "from_uri", "from_line", "to_line", F.concat(F.lit("Jump to matching clone in "), "uri").alias("title"),
        F.lit("showDocument").alias("command"), "uri", json.alias("range_json"),
    )


def largest_classes(ranged: DataFrame, count: int) -> DataFrame:
    sized = ranged.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_clones"), F.max(F.col("clone_size") + 1).alias("tokens"))
    return sized.orderBy(F.col("n_clones").desc(), "class_id").limit(count)


def averaged(results: DataFrame) -> DataFrame:
    """place, mean: of repeated runs' values (run, place, value), place by place."""
    return results.groupBy("place").agg(F.avg("value").alias("mean"))


def timings_line(results: DataFrame) -> DataFrame:
    """run, line: a run's values in order with commas."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"].cast("string"))
    return results.groupBy("run").agg(F.array_join(listed, ",").alias("line"))


