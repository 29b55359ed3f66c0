"""Signals in long form (song_id, i, y[, t]): levels, frames, smoothing, event starts, spans, fades and overlap-add.

Windows and grouped sums, but for event starts, which are a stream over each song's events.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.vectors import clip

def _by() -> WindowSpec:
    return Window.partitionBy("song_id")


def _order() -> WindowSpec:
    return _by().orderBy("i")


def peak_normalize(signal: DataFrame, peak: float = 0.9) -> DataFrame:
    """y scaled so that the song's largest |y| is `peak`, within -1 to 1; silence stays."""
    top = signal.groupBy("song_id").agg(F.max(F.abs("y")).alias("top"))
    scale = F.coalesce(F.nullif(F.col("top"), F.lit(0.0)), F.lit(1.0))
    return signal.join(top, "song_id").withColumn("y", clip(F.col("y") / scale * peak, -1.0, 1.0)).drop("top")


def pcm16(signal: DataFrame, peak: float = 0.89) -> DataFrame:
    """Normalised again, as 16-bit integers."""
    return peak_normalize(signal, peak).withColumn("y", F.round(F.col("y") * 32767).cast("short"))


def rms(y: Column) -> Column:
    """Root of the mean square, never quite 0; of no rows 0."""
    return F.coalesce(F.sqrt(F.avg(y * y) + 1e-12), F.lit(0.0))


def levels(signal: DataFrame) -> DataFrame:
    """Each song's rms, and its level: decibels above -60, as a part of 60."""
    r = signal.groupBy("song_id").agg(rms(F.col("y")).alias("rms"))
    return r.withColumn("level", clip((20 * F.log10(F.col("rms") + 1e-8) + 60) / 60, 0.0, 1.0))


def mean_std(signal: DataFrame) -> DataFrame:
    """Mean and population standard deviation."""
    return signal.groupBy("song_id").agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"))


def frame_rms(signal: DataFrame, hop: int = 8) -> DataFrame:
    """rms of frames of two hops at every hop, the last ones cut at the end: each value is in two frames at most."""
    f = F.floor(F.col("i") / hop)
    rows = signal.select("song_id", "y", F.explode(F.when(f > 0, F.array(f - 1, f)).otherwise(F.array(f))).alias("frame"))
    return rows.groupBy("song_id", "frame").agg(rms(F.col("y")).alias("rms"))


def moving_average(rows: DataFrame, value: str, order: str, k: int = 5) -> DataFrame:
    """Mean of k neighbours with zeros beyond both ends: always the sum over k."""
    w = _by().orderBy(order).rowsBetween(-(k // 2), k // 2)
    return rows.withColumn("smooth", F.sum(value).over(w) / k)


def smooth3(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Weights 1/4, 1/2, 1/4, the ends repeated."""
    w = _by().orderBy(order)
    own = F.col(value)
    return rows.withColumn("smooth", 0.25 * F.coalesce(F.lag(value).over(w), own) + 0.5 * own + 0.25 * F.coalesce(F.lead(value).over(w), own))


def temporal_pool(signal: DataFrame, bins: int = 4) -> DataFrame:
    """Means of `bins` nearly equal stretches, the first ones longer; stretches without rows are 0."""
    rows = signal.withColumn("bin", F.ntile(bins).over(_order())).groupBy("song_id", "bin").agg(F.avg("y").alias("mean"))
    grid = signal.select("song_id").distinct().select("song_id", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return grid.join(rows, ["song_id", "bin"], "left").select("song_id", F.col("bin").cast("long").alias("bin"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


def boundary_jump(signal: DataFrame, every: int = 10) -> DataFrame:
    """Median step at boundaries (every so many places) over the song's rms."""
    y = F.col("y")
    rows = signal.withColumns({"step": F.abs(y - F.lag("y").over(_order())), "scale": F.sqrt(F.avg(y * y).over(_by())) + 1e-6})
    at = (F.col("i") >= 1) & (F.col("i") % every == 0)
    return rows.groupBy("song_id").agg(F.coalesce(F.median(F.when(at, F.col("step") / F.col("scale"))), F.lit(0.0)).alias("jump"))


def _starts(batches: Iterator[pa.RecordBatch], hop: float, min_gap: float, fill: float) -> Iterator[pa.RecordBatch]:
    """Starts of songs whose events come in order: only the last start is kept."""
    now, last, place = object(), 0.0, 0
    for b in batches:
        out = []
        for song, t in zip(b.column("song_id").to_pylist(), b.column("t").to_pylist()):
            if song != now:
                now, last, place = song, 0.0, 1
                out.append((song, 0, 0.0))
            if t > last + min_gap:
                for k in range(1, max(0, math.ceil((t - last) / hop - fill)) + 1):
                    out.append((song, place, last + hop * k))
                    place += 1
                out.append((song, place, t))
                last, place = t, place + 1
        if out:
            songs, places, starts = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(songs, b.column("song_id").type), pa.array(places, pa.int64()), pa.array(starts, pa.float64())], names=["song_id", "place", "start"])


def event_starts(events: DataFrame, hop: float, min_gap: float, fill: float = 1.6) -> DataFrame:
    """(song_id, place, start): from 0, each event more than min_gap after the last start; gaps of over fill * hop filled by hops.

    events: (song_id, t). What is kept depends on what was kept before, so a song's events pass one task in order of time, in a
    stream that holds none of them.
    """
    rows = events.select("song_id", F.col("t").cast("double").alias("t")).where("t is not null").repartition("song_id").sortWithinPartitions("song_id", "t")
    kind = events.schema["song_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_starts, hop=hop, min_gap=min_gap, fill=fill), f"song_id {kind}, place long, start double")


def starts_within(starts: DataFrame, ends: DataFrame, window: float, least: int = 3) -> DataFrame:
    """Starts of at most end - .35 window, of songs that keep `least` of them."""
    kept = starts.join(ends, "song_id").where(F.col("start") <= F.greatest(F.lit(0.0), F.col("end") - 0.35 * window)).drop("end")
    return kept.withColumn("n", F.count("*").over(_by())).where(F.col("n") >= least).drop("n")


def segment_spans(starts: DataFrame, hop: float, window: float, scale: float = 1.0) -> DataFrame:
    """Each start's end: the next start and a short release, from .12 to 2 windows long; the last one a window long."""
    w = _by().orderBy("place")
    gap = F.lead("start").over(w) - F.col("start")
    release = min(0.08 * scale, 0.3 * hop)
    return starts.withColumn("end", F.col("start") + F.coalesce(clip(gap + release, 0.12 * scale, 2 * window), F.lit(window)))


def seam_fades(tiles: DataFrame, onsets: DataFrame, target: int, guard: int, tolerance: int) -> DataFrame:
    """Crossfade length at each tile's end: tiles (song_id, place, pos, span), onsets (song_id, at).

    `target` or half of either span, never below the guard (within the spans); about a third of that near an onset.
    """
    w = _by().orderBy("place")
    rows = tiles.withColumns({"next_span": F.lead("span").over(w), "edge": F.lead("pos").over(w)})
    # onsets meet edges in bins of a tolerance: three bins hold all within it
    bins = rows.where("edge is not null").select("song_id", "place", "edge", F.explode(F.expr(f"sequence(edge div {tolerance + 1} - 1, edge div {tolerance + 1} + 1)")).alias("bin"))
    near = bins.join(onsets.select("song_id", "at", F.expr(f"at div {tolerance + 1}").alias("bin")), ["song_id", "bin"]).where(F.abs(F.col("at") - F.col("edge")) <= tolerance)
    near = near.select("song_id", "place").distinct().withColumn("near", F.lit(True))
    xf = F.least(F.lit(target), F.expr("span div 2"), F.expr("next_span div 2"))
    seam = F.greatest(xf, F.least(F.lit(guard), F.col("span"), F.col("next_span")))
    short = F.greatest(F.lit(1), F.least(F.greatest(F.lit(guard), F.rint(xf * 0.35).cast("long")), F.col("span"), F.col("next_span")))
    fade = F.when(F.col("edge").isNull(), F.lit(0)).when(F.coalesce("near", F.lit(False)), F.least(seam, short)).otherwise(seam)
    return rows.join(near, ["song_id", "place"], "left").select("song_id", "place", "pos", "span", fade.cast("long").alias("fade"))


def overlap_add(tiles: DataFrame, floor: float = 1e-6) -> DataFrame:
    """(song_id, at, y): weighted mean of all tiles over a place. tiles: (song_id, place, pos, length, fade_in, fade_out, value).

    Equal-power fades; the divisor is the sum of weights.
    """
    from ..functions.costs import fade_in, fade_out

    k = F.col("k")
    rows = tiles.where("length > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("k"))
    rise = F.when(k < F.col("fade_in"), fade_in(k, F.col("fade_in"))).otherwise(F.lit(1.0))
    left = F.col("length") - F.col("fade_out")
    fall = F.when(k >= left, fade_out(k - left, F.col("fade_out"))).otherwise(F.lit(1.0))
    rows = rows.select("song_id", (F.col("pos") + k).alias("at"), "value", (rise * fall).alias("w"))
    sums = rows.groupBy("song_id", "at").agg(F.sum(F.col("w") * F.col("value")).alias("s"), F.sum("w").alias("w"))
    return sums.select("song_id", "at", F.when(F.col("w") > floor, F.col("s") / F.col("w")).otherwise(F.col("s")).alias("y"))


def soft_limit(signal: DataFrame, ceiling: float = 0.99) -> DataFrame:
    """Songs with a larger peak scaled down to the ceiling."""
    top = signal.groupBy("song_id").agg(F.max(F.abs("y")).alias("top"))
    return signal.join(top, "song_id").withColumn("y", F.when(F.col("top") > ceiling, F.col("y") / F.col("top") * ceiling).otherwise(F.col("y"))).drop("top")


def loudness_gain(own: Column, reference: Column, blend: float = 0.85) -> Column:
    """(reference / own) ** blend, from .35 to 3.5."""
    return clip(F.pow(F.greatest(reference, F.lit(1e-6)) / F.greatest(own, F.lit(1e-6)), F.lit(blend)), 0.35, 3.5)


def interpolated(points: DataFrame, places: DataFrame) -> DataFrame:
    """places (song_id, x) with y on the line between the points (song_id, x, y) around; beyond them the end's y."""
    rows = points.select("song_id", "x", "y", F.lit(True).alias("p")).unionByName(places.select("song_id", "x", F.lit(None).cast("double").alias("y"), F.lit(False).alias("p")))
    w = _by().orderBy("x", F.desc("p"))
    point = F.when(F.col("p"), F.struct("x", "y"))
    rows = rows.withColumns({"a": F.last(point, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "b": F.first(point, True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    a, b = F.col("a"), F.col("b")
    line = a["y"] + (b["y"] - a["y"]) * (F.col("x") - a["x"]) / (b["x"] - a["x"])
    y = F.when(a.isNull(), b["y"]).when(b.isNull() | (a["x"] == b["x"]), a["y"]).otherwise(line)
    return rows.where(~F.col("p")).select("song_id", "x", y.alias("y"))


def correlation(pairs: DataFrame) -> DataFrame:
    """Pearson's r of (song_id, a, b) within -1 to 1; 0 of fewer than two rows or of a constant."""
    stats = pairs.groupBy("song_id").agg(F.count("*").alias("n"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"), F.covar_pop("a", "b").alias("c"))
    flat = (F.col("n") < 2) | (F.col("sa") < 1e-8) | (F.col("sb") < 1e-8)
    return stats.select("song_id", F.when(flat, F.lit(0.0)).otherwise(clip(F.col("c") / F.nullif(F.col("sa") * F.col("sb"), F.lit(0.0)), -1.0, 1.0)).alias("r"))
