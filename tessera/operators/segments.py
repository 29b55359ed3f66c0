"""Frames to segments: descriptors of stretches of a song from its frames' features, as sums that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import clip, unit
from .render import BLOCK, stretches
from .resynthesis import lengths

BIN = 64  # frames of a bin: segments meet frames in the bins that they touch
POOLS = 4
WIDTHS = {"chroma": 12, "register": 6, "mfcc": 13, "contrast": 7}


def frame_ranges(segments: DataFrame, frames: DataFrame, sr: int, hop: int) -> DataFrame:
    """segments (song_id, start_s, end_s, ...) with f0 and f1 (exclusive): within the song's frames, at least one."""
    n = frames.groupBy("song_id").agg((F.max("f") + 1).alias("n_frames"))
    at = lambda s: F.expr(f"cast(rint({s} * {sr}) as bigint) div {hop}")
    out = segments.join(n, "song_id").withColumn("f0", F.greatest(F.lit(0), F.least(at("start_s"), F.col("n_frames") - 1)))
    return out.withColumn("f1", F.greatest(F.col("f0") + 1, F.least(at("end_s"), F.col("n_frames")))).drop("n_frames")


def _pool(place: Column, n: Column) -> Column:
    """Which of POOLS nearly equal stretches of n a place is in; the first ones are longer."""
    q = F.floor(n / POOLS)
    long = (n % POOLS) * (q + 1)
    return F.when(place < long, F.floor(place / (q + 1))).otherwise(n % POOLS + F.floor((place - long) / F.greatest(q, F.lit(1))))


def described(frames: DataFrame, segments: DataFrame, sr: int, hop: int, widths: dict[str, int] = WIDTHS) -> DataFrame:
    """segments (segment, song_id, start_s, end_s) with n_frames and unit-length chroma, temporal, timbre, energy, register, and level.

    frames: (song_id, f, chroma, register, mfcc, contrast: arrays of `widths`; rms, centroid, flatness, onset). Each block is of means over the
    segment's frames: timbre has the mean and deviation of mfcc and the mean of contrast; energy mean and deviation of rms and centroid, mean of
    flatness and onset; temporal the means of chroma in four stretches (zeros where one has no frame).
    """
    ranges = frame_ranges(segments, frames, sr, hop).select("segment", "song_id", "f0", "f1")
    asked = ranges.withColumn("bin", F.explode(F.expr(f"sequence(f0 div {BIN}, (f1 - 1) div {BIN})")))
    rows = asked.join(frames.withColumn("bin", F.expr(f"f div {BIN}")), ["song_id", "bin"]).where("f >= f0 and f < f1")
    rows = rows.withColumn("pool", _pool(F.col("f") - F.col("f0"), F.col("f1") - F.col("f0")))
    at = lambda c, i: F.get(c, F.lit(i))
    sums = {f"{c}_{i}": F.avg(at(c, i)) for c, w in widths.items() for i in range(w)}
    sums |= {f"mfcc_s{i}": F.stddev_pop(at("mfcc", i)) for i in range(widths["mfcc"])}
    sums |= {f"pool_{b}_{i}": F.avg(F.when(F.col("pool") == b, at("chroma", i))) for b in range(POOLS) for i in range(widths["chroma"])}
    sums |= {c: F.avg(c) for c in ("rms", "centroid", "flatness", "onset")} | {f"{c}_s": F.stddev_pop(c) for c in ("rms", "centroid")}
    found = rows.groupBy("segment").agg(F.count("*").alias("n_frames"), *(v.alias(k) for k, v in sums.items()))
    of = lambda names: F.array(*[F.coalesce(n, F.lit(0.0)) for n in names])
    blocks = {c: of([f"{c}_{i}" for i in range(w)]) for c, w in widths.items() if c in ("chroma", "register")}
    blocks["timbre"] = of([f"mfcc_{i}" for i in range(widths["mfcc"])] + [f"mfcc_s{i}" for i in range(widths["mfcc"])] + [f"contrast_{i}" for i in range(widths["contrast"])])
    blocks["temporal"] = of([f"pool_{b}_{i}" for b in range(POOLS) for i in range(widths["chroma"])])
    blocks["energy"] = of(["rms", "rms_s", "centroid", "centroid_s", "flatness", "onset"])
    level = clip((20 * F.log10(F.col("rms") + 1e-8) + 60) / 60, 0.0, 1.0)
    rows = found.select("segment", "n_frames", *(v.alias(k) for k, v in blocks.items()), level.alias("level"))
    return segments.join(rows.select("segment", "n_frames", *(unit(k).alias(k) for k in blocks), "level"), "segment")


def grid_segments(waves: DataFrame, sr: int, window_s: float = 0.45, hop_s: float = 0.22, size: int = BLOCK) -> DataFrame:
    """(song_id, segment_idx, start_s, end_s, samples): pieces of a window at every hop, padded with silence; the last is the first that reaches the end.

    waves: in blocks (see render), of which each piece reads those that it touches.
    """
    if window_s <= 0 or hop_s <= 0:
        raise ValueError("window and hop must be positive")
    window, hop = round(window_s * sr), round(hop_s * sr)
    n = lengths(waves).where("n_samples > 0")
    # the last start is before the end, and its forerunner's window does not reach the end
    last = F.least(F.expr(f"greatest(n_samples - 2, 0L) div {hop}"), F.greatest(F.lit(0), F.ceil((F.col("n_samples") - window) / hop)))
    asked = n.select("song_id", "n_samples", F.lit("song").alias("kind"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("segment_idx")).withColumns({"a": F.col("segment_idx") * hop, "n": F.lit(window).cast("long")})
    cut = stretches(asked, waves, ["song_id", "kind", "a", "n", "segment_idx", "n_samples"], size)
    return cut.select("song_id", "segment_idx", (F.col("a") / sr).alias("start_s"), (F.least(F.col("a") + window, F.col("n_samples")) / sr).alias("end_s"), "samples")
