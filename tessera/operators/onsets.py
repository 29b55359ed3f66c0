"""Onsets of long signals: peaks of a strength curve over running means and maxima, moved back to the last minimum."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import SIZE, haloed, latest


@dataclass(frozen=True)
class PeakParams:
    """Reaches in frames: a peak is the largest of pre_max before to post_max - 1 behind, and delta above the mean of pre_avg before to post_avg - 1 behind."""

    pre_max: int = 2
    post_max: int = 1
    pre_avg: int = 8
    post_avg: int = 9
    wait: int = 2
    delta: float = 0.07


def flux(frames: DataFrame, column: str) -> DataFrame:
    """(song_id, f, strength): mean rise of the frames' vectors over the frame before; 0 of the first."""
    before = frames.select("song_id", (F.col("f") + 1).alias("f"), F.col(column).alias("before"))
    rise = F.aggregate(F.zip_with(column, "before", lambda x, y: F.greatest(x - y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x) / F.size(column)
    return frames.join(before, ["song_id", "f"], "left").select("song_id", "f", F.round(F.coalesce(rise, F.lit(0.0)), 9).alias("strength"))


def onsets(strength: DataFrame, p: PeakParams = PeakParams(), size: int = SIZE) -> DataFrame:
    """(song_id, f, start): each onset's frame and the last minimum of the curve at or before it (0 if none).

    strength: (song_id, f from 0 without gaps, strength), scaled to 0..1 in a song first; a flat curve has no onsets. An onset is more
    than `wait` frames after the last one: chains of peaks within `wait` of each other are settled apart, one by one.
    """
    ends = strength.groupBy("song_id").agg(F.min("strength").alias("low"), F.max("strength").alias("high"), F.max("f").alias("last"))
    x = (F.col("strength") - F.col("low")) / (F.col("high") - F.col("low"))
    rows = strength.join(ends, "song_id").where("high > low").select("song_id", "f", "last", x.alias("x"))
    rows, w = haloed(rows, ["song_id"], "f", max(p.pre_max, p.pre_avg, 1), max(p.post_max, p.post_avg, 1), size)
    most = F.max("x").over(w.rowsBetween(-p.pre_max, p.post_max - 1))
    mean = F.avg("x").over(w.rowsBetween(-p.pre_avg, p.post_avg - 1))
    inside = (F.col("f") > 0) & (F.col("f") < F.col("last"))
    low = inside & (F.col("x") <= F.lag("x").over(w)) & (F.col("x") < F.lead("x").over(w))
    rows = rows.select("song_id", "f", "_own", ((F.col("x") == most) & (F.col("x") >= mean + p.delta)).alias("peak"), low.alias("low")).where("_own").drop("_own")
    rows = latest(rows, ["song_id"], "f", F.when(F.col("low"), F.col("f")), "start", size)
    # a peak without another within `wait` before it starts a chain
    rows, w = haloed(rows, ["song_id"], "f", p.wait, 0, size)
    near = F.max(F.when(F.col("peak"), F.col("f"))).over(w.rowsBetween(-p.wait, -1)) if p.wait else F.lit(None)
    rows = rows.withColumn("head", F.col("peak") & near.isNull()).where("_own").drop("_own", "_block")
    peaks = latest(rows, ["song_id"], "f", F.when(F.col("head"), F.col("f")), "chain", size).where("peak")
    chains = peaks.groupBy("song_id", "chain").agg(F.array_sort(F.collect_list(F.struct("f", "start"))).alias("peaks"))
    first = F.slice("peaks", 1, 1)
    kept = F.aggregate(F.slice("peaks", 2, F.greatest(F.size("peaks") - 1, F.lit(0))), first, lambda k, c: F.when(c["f"] > F.element_at(k, -1)["f"] + p.wait, F.concat(k, F.array(c))).otherwise(k))
    return chains.select("song_id", F.inline(kept)).withColumn("start", F.coalesce("start", F.lit(0).cast("long")))
