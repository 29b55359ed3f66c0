"""How close a rendering is to its target, from sums over blocks of frames: a sound of any length is many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import hann, mel_bank, pitch_class_bank
from ..functions.vectors import clip
from .render import BLOCK, stretches
from .resynthesis import FRAMES, lengths
from .signals import correlation

MELS = (512, 1024, 2048)
FRAME, CHROMA_HOP, ONSET_HOP = 2048, 512, 256
SPAN = 80.0  # decibels below a sound's loudest band that count
# what is measured: its frame and hop
MEASURES = {**{f"mel{s}": (s, s // 4) for s in MELS}, "chroma": (FRAME, CHROMA_HOP), "onset": (FRAME, ONSET_HOP)}
LEAST = 64  # samples


def _power(samples: np.ndarray, size: int, hop: int) -> np.ndarray:
    return np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(samples, size)[::hop] * hann(size), axis=1)) ** 2


def _measured(what: str, first: int, ref: np.ndarray, est: np.ndarray, sr: int) -> list[tuple[int, list, list]]:
    """(frame, a, b) rows: of mels and chroma one, with sums; of onsets one for each frame, with both sounds' band levels."""
    size, hop = MEASURES[what]
    a, b = (_power(x, size, hop) for x in (ref, est))
    if what == "onset":
        a, b = (10 * np.log10(np.maximum(x @ mel_bank(sr, size, 128).T, 1e-10)) for x in (a, b))
        return [(first + i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))]
    if what == "chroma":
        a, b = (c / np.maximum(c.max(1, keepdims=True), 1e-8) for c in (x @ pitch_class_bank(sr, size).T for x in (a, b)))
        norms = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
        ok = norms > 1e-8
        return [(first, [float(ok.sum()), float(((a * b).sum(1)[ok] / norms[ok]).sum())], [])]
    a, b = (np.log1p(x @ mel_bank(sr, size, 64).T) for x in (a, b))
    return [(first, [float(a.size), float(np.abs(a - b).sum()), float(np.abs(a).sum())], [])]


ROWS = "target string, what string, f long, a array<double>, b array<double>"


def _frames(reference: DataFrame, estimate: DataFrame, both: DataFrame, sr: int, block: int) -> DataFrame:
    """ROWS of all measures. both: (song_id, n_samples), what the two have in common."""
    kinds = F.array(*[F.struct(F.lit(k).alias("what"), F.lit(s).cast("long").alias("size"), F.lit(h).cast("long").alias("hop")) for k, (s, h) in MEASURES.items()])
    parts = both.where(F.col("n_samples") >= LEAST).select("song_id", "n_samples", F.inline(kinds)).withColumn("n_frames", F.expr("n_samples div hop") + 1)
    parts = parts.withColumn("part", F.explode(F.expr(f"sequence(0L, (n_frames - 1) div {FRAMES})")))
    parts = parts.withColumns({"f0": F.col("part") * FRAMES, "f1": F.least((F.col("part") + 1) * FRAMES, F.col("n_frames")), "kind": F.lit("song")})
    parts = parts.withColumns({"a": F.col("f0") * F.col("hop") - F.expr("size div 2"), "n": (F.col("f1") - 1 - F.col("f0")) * F.col("hop") + F.col("size")})
    keys = ["song_id", "kind", "a", "n", "what", "part", "f0", "n_samples"]
    # what one sound has beyond the other's end counts as silence
    sound = lambda waves, name: stretches(parts.select(*keys), waves, keys, block).withColumn(name, F.transform("samples", lambda x, i: F.when(F.col("a") + i < F.col("n_samples"), x).otherwise(F.lit(0.0)))).drop("samples")
    rows = sound(reference, "ref").join(sound(estimate, "est"), keys, "full").select("song_id", "what", "f0", "n", "ref", "est")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ref, est = (np.asarray(row[c] or np.zeros(row["n"]), float) for c in ("ref", "est"))
                found = _measured(row["what"], row["f0"], ref, est, sr)
                f, a, b = zip(*found)
                lists = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([row["song_id"]] * len(f)), pa.array([row["what"]] * len(f)), pa.array(f, pa.int64()), pa.array(a, lists), pa.array(b, lists)], names=[c.split()[0] for c in ROWS.split(", ")])

    return rows.mapInArrow(measure, ROWS)


def _onset_correlation(rows: DataFrame) -> DataFrame:
    """(target, onset): Pearson's r of the mean rises of both sounds' band levels, from SPAN below their loudest."""
    levels = rows.where("what = 'onset'")
    top = levels.groupBy("target").agg(F.max(F.array_max("a")).alias("top_a"), F.max(F.array_max("b")).alias("top_b"))
    before = levels.select("target", (F.col("f") + 1).alias("f"), F.col("a").alias("last_a"), F.col("b").alias("last_b"))
    pairs = levels.join(before, ["target", "f"], "left").join(top, "target")

    def rise(side: str) -> F.Column:
        low = F.col(f"top_{side}") - SPAN
        grown = F.zip_with(side, f"last_{side}", lambda x, y: F.greatest(F.greatest(x, low) - F.greatest(y, low), F.lit(0.0)))
        return F.coalesce(F.aggregate(grown, F.lit(0.0), lambda s, x: s + x) / F.size(side), F.lit(0.0))

    r = correlation(pairs.select(F.col("target").alias("song_id"), rise("a").alias("a"), rise("b").alias("b")))
    return r.select(F.col("song_id").alias("target"), F.col("r").alias("onset"))


def boundary_jumps(estimate: DataFrame, boundaries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(target, boundary): median step of the sound at its boundaries (target, at) over its rms; sounds without any have no row."""
    own = estimate.where("kind = 'song'").select(F.col("song_id").alias("target"), "block", "samples")
    scale = own.groupBy("target").agg((F.sqrt(F.sum(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x * x)) / F.sum(F.size("samples"))) + 1e-6).alias("scale"))
    places = boundaries.where("at >= 1").select("target", "at", F.explode(F.array("at", F.col("at") - 1)).alias("p")).withColumn("block", F.expr(f"p div {block}"))
    values = places.join(own, ["target", "block"]).withColumn("y", F.get("samples", (F.col("p") % block).cast("int"))).where("y is not null")
    steps = values.groupBy("target", "at").agg(F.max("y").alias("high"), F.min("y").alias("low"), F.count("*").alias("n")).where("n = 2")
    return steps.join(scale, "target").groupBy("target").agg(F.median((F.col("high") - F.col("low")) / F.col("scale")).alias("boundary"))


def compared(reference: DataFrame, estimate: DataFrame, sr: int, boundaries: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(target, log_mel, chroma, onset, boundary) of every song_id of `reference`, to four places.

    Waveforms in blocks (see render). log_mel: mean relative difference of log mel power at three resolutions. chroma: mean cosine of frames' pitch
    classes, 0 to 1. onset: correlation of rises. Over what both sounds have; 0 of fewer than 64 samples. boundary: see boundary_jumps(), 0 without.
    """
    n = lengths(reference).join(lengths(estimate).withColumnRenamed("n_samples", "m"), "song_id", "left")
    both = n.select("song_id", F.least("n_samples", F.coalesce("m", F.lit(0))).alias("n_samples"))
    rows = _frames(reference, estimate, both, sr, block)
    at = lambda i: F.sum(F.get("a", F.lit(i)))
    mels = rows.where("what like 'mel%'").groupBy("target", "what").agg((at(1) / at(0) / (at(2) / at(0) + 1e-6)).alias("d")).groupBy("target").agg(F.avg("d").alias("log_mel"))
    chroma = rows.where("what = 'chroma'").groupBy("target").agg(clip(F.coalesce(at(1) / F.nullif(at(0), F.lit(0.0)), F.lit(0.0)), 0.0, 1.0).alias("chroma"))
    out = n.select(F.col("song_id").alias("target")).join(mels, "target", "left").join(chroma, "target", "left").join(_onset_correlation(rows), "target", "left")
    out = out.join(boundary_jumps(estimate, boundaries, block), "target", "left") if boundaries is not None else out.withColumn("boundary", F.lit(0.0))
    return out.select("target", *(F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("log_mel", "chroma", "onset", "boundary")))
