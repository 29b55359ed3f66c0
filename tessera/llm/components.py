"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, with_group

MAX_STEPS = 60  # each step shortens paths by a constant factor; 60 suffice for any table


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
    return r["n"], r["h"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every vertex hands its smallest neighbour (or itself) to its larger (large) or not larger (small) neighbours.

    Only a minimum for each vertex is gathered, never its neighbours; a hot vertex's rows are dealt over several tasks.
    """
    if large:
        near = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    pairs = with_group(near, ["u"], "v", [F.min("v").alias("m")]).withColumn("m", F.least("m", "u"))
    if large:
        return pairs.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(pairs.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component_id = smallest node reachable) of every node in a link; rows with equal or null ends count for nothing.

    An empty table gives an empty one. Repeated and reversed links change nothing.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    was = _digest(edges)
    for _ in range(MAX_STEPS if was[0] else 0):
        new = materialize(_star(_star(edges, True), False), "links")
        now = _digest(new)
        discard(edges)
        edges = new
        if now == was:
            break
        was = now
    else:
        if was[0]:
            raise RuntimeError("components did not settle")
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component_id"))
    return roots.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct())
