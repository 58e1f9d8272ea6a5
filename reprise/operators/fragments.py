"""Fragments: what clones are looked for in, and the filters and projections on their tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reprise.functions.text import char_of_part, word_starts, words

#: In front of a token's type where it stands for the token, so that no token's text equals it.
BLIND = "\x01"


def line_fragments(documents: DataFrame, text: str = "text") -> DataFrame:
    """Lines of words: uri, frag_id (the line's number), line, toks."""
    return documents.select("uri", F.posexplode(F.split(text, "\n")).alias("frag_id", "line")).withColumn("toks", words(F.col("line")))


def line_ranges(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds start_line, start_char, end_line, end_char (0-based, end exclusive) to clones of lines of words."""
    at = word_starts(F.col("line"))
    last = F.get(at, F.col("off") + F.col("clone_size"))
    end = char_of_part(F.col("line"), last) + F.length(F.get(F.split("line", " "), last))
    joined = nodes.join(lines.select("uri", "frag_id", "line"), ["uri", "frag_id"])
    return joined.select(
        *nodes.columns,
        F.col("frag_id").alias("start_line"),
        char_of_part(F.col("line"), F.get(at, F.col("off"))).cast("int").alias("start_char"),
        F.col("frag_id").alias("end_line"),
        end.cast("int").alias("end_char"),
    )


def code_ranges(nodes: DataFrame, fragments: DataFrame) -> DataFrame:
    """The same for fragments with a tokens array of struct (type, text, start_line, start_char, end_line, end_char)."""
    first, last = F.get("tokens", F.col("off")), F.get("tokens", F.col("off") + F.col("clone_size"))
    joined = nodes.join(fragments.select("uri", "frag_id", "tokens"), ["uri", "frag_id"])
    return joined.select(
        *nodes.columns,
        first["start_line"].alias("start_line"),
        first["start_char"].alias("start_char"),
        last["end_line"].alias("end_line"),
        last["end_char"].alias("end_char"),
    )


def outermost(fragments: DataFrame, start: str = "start", end: str = "end", kind: str = "frag_type") -> DataFrame:
    """Drops fragments inside another of the same type of the same document; types may nest in each other."""
    order = W.partitionBy("uri", kind).orderBy(F.col(start), F.col(end).desc()).rowsBetween(W.unboundedPreceding, -1)
    return fragments.withColumn("_reach", F.max(end).over(order)).where(F.col("_reach").isNull() | (F.col("_reach") < F.col(end))).drop("_reach")


def keep_token(token: Column, ignore: tuple[str, ...], extra: tuple[str, ...]) -> Column:
    """Leaves stay, inner nodes only if their type is in `extra`; types in `ignore` and comments go."""
    stays = F.coalesce(token["leaf"], F.lit(True)) | token["type"].isin(*extra)
    return stays & ~token["type"].isin(*ignore, "comment", "line_comment", "block_comment")


def token_value(token: Column, blind: tuple[str, ...]) -> Column:
    return F.when(token["type"].isin(*blind), F.concat(F.lit(BLIND), token["type"])).otherwise(token["text"])


def token_values(fragments: DataFrame, ignore: tuple[str, ...] = (), extra: tuple[str, ...] = (), blind: tuple[str, ...] = ()) -> DataFrame:
    """Filters the tokens array and adds toks, what clones compare."""
    kept = F.filter("tokens", lambda t: keep_token(t, ignore, extra))
    return fragments.withColumn("tokens", kept).withColumn("toks", F.transform("tokens", lambda t: token_value(t, blind)))


def blind_words(toks: Column) -> Column:
    """Words of prose that differ only in case or digits look alike."""
    return F.transform(toks, lambda w: F.regexp_replace(F.lower(w), "[0-9]+", "#"))


def size_filter(fragments: DataFrame, least: int, most: int) -> DataFrame:
    return fragments.where(F.size("toks").between(least, most))
