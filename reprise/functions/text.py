"""Column functions on text, words and ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once: what a lambda uses from outside is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(line: Column) -> Column:
    """The words of a line, separated by blanks."""
    return F.array_remove(F.split(line, " "), "")


def word_starts(line: Column) -> Column:
    """Where in split(line, ' ') the words are, from 0."""
    return let(F.split(line, " "), lambda parts: F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.get(parts, i) != ""))


def char_of_part(line: Column, part: Column) -> Column:
    """The character at which a part of split(line, ' ') begins."""
    parts = F.split(line, " ")
    return F.when(part > 0, F.length(F.array_join(F.slice(parts, F.lit(1), part), " ")) + 1).otherwise(0)


def drop_unterminated_line(text: Column) -> Column:
    """The text up to its last line feed."""
    return F.regexp_replace(text, r"\n[^\n]*\z", "")


def position_offset(text: Column, line: Column, char: Column) -> Column:
    """The 0-based offset of a (line, character) position; a position at the end is the text's length."""
    before = F.slice(F.split(text, "\n"), F.lit(1), line)
    return F.when(line > 0, F.length(F.array_join(before, "\n")) + 1).otherwise(0) + char


def splice(text: Column, start: Column, end: Column, new: Column) -> Column:
    """text[:start] + new + text[end:], 0-based."""
    return F.concat(F.substring(text, F.lit(1), start), new, F.substring(text, end + 1, F.length(text)))


def apply_edits(text: Column, edits: Column) -> Column:
    """Ranged edits, each on the result of the one before. edits: array of struct
    (start_line, start_char, end_line, end_char, text); a null array is no edit."""

    def one(so_far: Column, e: Column) -> Column:
        start = position_offset(so_far, e["start_line"], e["start_char"])
        end = position_offset(so_far, e["end_line"], e["end_char"])
        return splice(so_far, start, end, e["text"])

    return F.coalesce(F.aggregate(edits, text, one), text)


def common_prefix(a: Column, b: Column) -> Column:
    """How many elements two arrays share at the start."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differ > 0, differ - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def file_name(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), -1)


def folder_name(uri: Column) -> Column:
    """The last folder of a path, empty if there is none."""
    return F.coalesce(F.try_element_at(F.split(uri, "/"), F.lit(-2)), F.lit(""))


def extension(uri: Column) -> Column:
    return F.regexp_extract(file_name(uri), r"\.([^.]*)$", 1)
