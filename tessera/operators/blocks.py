"""Windows over long sequences: rows of a sequence are dealt into blocks, so that no sequence is one task's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SIZE = 8192


def haloed(rows: DataFrame, by: list[str], at: str, before: int, after: int, size: int = SIZE) -> tuple[DataFrame, WindowSpec]:
    """(rows in blocks, each block with the rows up to `before` places before and `after` behind it; a window over blocks).

    What is computed over the window, within that reach, holds for rows with `_own`; keep only these. `at`: place from 0.
    """
    if max(before, after) > size:
        raise ValueError("a window may reach one block on")
    place, own = F.col(at), F.floor(F.col(at) / size).cast("long")
    # a row near its block's end is before the next one, near its start behind the last one
    beside = F.filter(F.array(F.when(place % size < after, own - 1), own, F.when(place % size >= size - before, own + 1)), lambda b: b.isNotNull() & (b >= 0))
    out = rows.select("*", F.explode(beside).alias("_block")).withColumn("_own", F.col("_block") == own)
    return out, Window.partitionBy(*by, "_block").orderBy(at)


def latest(rows: DataFrame, by: list[str], at: str, value: Column, name: str, size: int = SIZE) -> DataFrame:
    """rows with the last `value` that isn't null, at the row or before it: within blocks, then from block to block."""
    out = rows.withColumns({"_block": F.floor(F.col(at) / size).cast("long"), "_value": value})
    ends = out.groupBy(*by, "_block").agg(F.max(F.when(F.col("_value").isNotNull(), F.struct(at, "_value")))["_value"].alias("_end"))
    past = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_past", F.last("_end", ignorenulls=True).over(past)).drop("_end")
    here = Window.partitionBy(*by, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_here", F.last("_value", ignorenulls=True).over(here)).join(ends, [*by, "_block"])
    return out.withColumn(name, F.coalesce("_here", "_past")).drop("_block", "_value", "_here", "_past")
