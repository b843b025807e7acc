"""Subscripts on table items."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def subscript(items: Column, index: Column | int, count: Column | None = None, least: int = 1) -> Column:
    """``t(i)``, from one. With ``count`` (DEPENDING ON) an index past it, or
    below ``least``, fails the row; without it such an entry is null."""
    i = index if isinstance(index, Column) else F.lit(index)
    entry = F.get(items, i - 1)
    if count is None:
        return entry
    bad = (i < least) | (i > count)
    text = F.concat(F.lit("subscript "), i.cast("string"), F.lit(" outside "), F.lit(f"{least} to "), count.cast("string"))
    # the failing branch must not be folded away with the entry's type
    checked = F.when(bad, F.raise_error(text).cast("int")).otherwise(i)
    return F.get(items, checked - 1)


def varying(count: Column | int, start, step):
    """PERFORM VARYING i FROM 1 BY 1 UNTIL i > count, folding ``step(acc, i)``."""
    n = count if isinstance(count, Column) else F.lit(count)
    turns = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, start, step)
