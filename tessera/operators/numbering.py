"""Running numbers over rows of any count: ranges are sorted apart, and each is told how much lies before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

_INDEX = (1 << 33) - 1  # monotonically_increasing_id: the partition above these bits, the row in it below


def numbered(rows: DataFrame, order: list[str], by: list[str] | None = None, name: str = "place", weight: Column | None = None) -> DataFrame:
    """rows with `name`: how many rows lie before each in `order`, within its group `by`; with `weight`, the sum of theirs.

    Rows are dealt out by ranges of (by, order), so neither a large group nor the whole is one task's. `order` should be a key: rows
    that are equal in it stay together and get numbers in any order. Nulls sort first.
    """
    by = by or []
    keys = [*by, *order]
    ranged = rows.withColumn("_weight", weight if weight is not None else F.lit(1).cast("long")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = written(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranged").withColumn("_range", F.shiftright("_id", 33))
    groups = ["_range", *by]
    facts = ranged.groupBy(*groups).agg(F.sum("_weight").alias("_sum"), F.min("_id").alias("_first"))
    # a group has at most one of these rows for each range
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    facts = facts.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    same = F.lit(True)
    for c in groups:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}"))
    out = ranged.alias("r").join(facts.alias("f"), same).select("r.*", "_first", "_before")
    if weight is None:
        own = F.col("_id").bitwiseAND(F.lit(_INDEX)) - F.col("_first").bitwiseAND(F.lit(_INDEX))
    else:
        own = F.coalesce(F.sum("_weight").over(Window.partitionBy(*groups).orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.withColumn(name, (F.col("_before") + own).cast("long")).drop("_weight", "_id", "_range", "_first", "_before")


def dense_index(rows: DataFrame, keys: list[str], name: str = "index") -> tuple[DataFrame, DataFrame]:
    """(distinct keys with their number from 0 in sorted order, rows with their key's number)."""
    distinct = written(numbered(rows.select(*keys).distinct(), keys, name=name), "index")
    return distinct, rows.join(distinct, keys)
