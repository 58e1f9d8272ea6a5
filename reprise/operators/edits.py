"""Edits between two versions of a token sequence.

An edit script is an array of struct (op, pos, toks): INSERT, DELETE and SUBSTITUTE, positions in the old
sequence, from right to left so that applying one leaves the others' positions valid.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reprise.functions.text import common_prefix

#: From this many operations on a script becomes one DELETE and one INSERT.
COLLAPSE = 10
OP = pa.struct([("op", pa.string()), ("pos", pa.int32()), ("toks", pa.list_(pa.string()))])


def trim(old: Column, new: Column) -> tuple[Column, Column]:
    """(tokens that both have at the start, tokens that both have at the end, without overlap)."""
    start = common_prefix(old, new)
    rest = lambda x: F.reverse(F.slice(x, start + 1, F.size(x)))
    return start, common_prefix(rest(old), rest(new))


def edit_trim(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Adds start, end (tokens shared there), deleted and inserted (what is between): the collapsed script."""
    start, end = trim(F.col(old), F.col(new))
    middle = lambda x: F.slice(F.col(x), F.col("start") + 1, F.size(x) - F.col("start") - F.col("end"))
    return (
        pairs.withColumn("start", start).withColumn("end", end).withColumn("deleted", middle(old)).withColumn("inserted", middle(new))
    )


def script(old: list[str], new: list[str], collapse: int = COLLAPSE) -> list[tuple[str, int, list[str]]]:
    """The script that turns old into new."""
    start = 0
    while start < min(len(old), len(new)) and old[start] == new[start]:
        start += 1
    end = 0
    while end < min(len(old), len(new)) - start and old[-1 - end] == new[-1 - end]:
        end += 1
    a, b = old[start : len(old) - end], new[start : len(new) - end]
    ops = []
    for tag, i1, i2, j1, j2 in reversed(SequenceMatcher(None, a, b, autojunk=False).get_opcodes()):
        if tag == "replace":
            same = min(i2 - i1, j2 - j1)
            if j2 - j1 > same:
                ops.append(("INSERT", start + i1 + same, b[j1 + same : j2]))
            if i2 - i1 > same:
                ops.append(("DELETE", start + i1 + same, a[i1 + same : i2]))
            ops.append(("SUBSTITUTE", start + i1, b[j1 : j1 + same]))
        elif tag == "insert":
            ops.append(("INSERT", start + i1, b[j1:j2]))
        elif tag == "delete":
            ops.append(("DELETE", start + i1, a[i1:i2]))
    if len(ops) >= collapse:
        ops = [(op, start, toks) for op, toks in (("DELETE", a), ("INSERT", b)) if toks]
    return ops


def apply_script(old: list[str], ops: list[tuple[str, int, list[str]]]) -> list[str]:
    out = list(old)
    for op, pos, toks in ops:
        out[pos : pos + (0 if op == "INSERT" else len(toks))] = [] if op == "DELETE" else toks
    return out


def _scripts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)
        ops = [[{"op": o, "pos": p, "toks": t} for o, p, t in script(a or [], b or [])] for a, b in pairs]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ops, pa.list_(OP))], [*batch.schema.names, "ops"])


def edit_script(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Adds ops. Finding a script has no SQL; whole batches of pairs go through Arrow."""
    others = [c for c in pairs.columns if c not in (old, new)]
    given = pairs.select(*others, old, new)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)
    return given.mapInArrow(_scripts, f"{kinds}, ops array<struct<op:string,pos:int,toks:array<string>>>")


def applied(old: Column, ops: Column) -> Column:
    """The sequence after the operations."""

    def one(so_far: Column, e: Column) -> Column:
        gone = F.when(e["op"] == "INSERT", 0).otherwise(F.size(e["toks"]))
        come = F.when(e["op"] == "DELETE", F.array().cast("array<string>")).otherwise(e["toks"])
        return F.concat(F.slice(so_far, F.lit(1), e["pos"]), come, F.slice(so_far, e["pos"] + gone + 1, F.size(so_far)))

    return F.aggregate(ops, old, one)
