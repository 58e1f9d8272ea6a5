"""Bitmaps of fixed size over 64-bit keys, which keep rows back that cannot match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmap_cells(keys: DataFrame, key: Column, log2: int) -> DataFrame:
    """cell, bits: a bitmap of 2**log2 bits over 64-bit keys, as at most 2**log2 / 64 rows."""
    slots = keys.select(F.shiftrightunsigned(key, 64 - log2).alias("slot"))
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    return slots.groupBy(F.shiftright("slot", 6).alias("cell")).agg(F.bit_or(bit).alias("bits"))


def may_match(rows: DataFrame, key: Column, cells: DataFrame, log2: int, whether: bool = True) -> DataFrame:
    """The rows whose key may be in the bitmap, or those whose key is not; its size is fixed, so it can be broadcast."""
    slot = F.shiftrightunsigned(key, 64 - log2)
    held = cells.select(F.col("cell").alias("_cell"), F.col("bits").alias("_bits"))
    keyed = rows.withColumn("_slot", slot)
    hit = F.expr("(shiftrightunsigned(_bits, cast(_slot & 63 as int)) & 1) = 1")
    return keyed.join(F.broadcast(held), (F.shiftright("_slot", 6) == F.col("_cell")) & hit, "left_semi" if whether else "left_anti").drop("_slot")
