"""Tables of tracks (song_id, sr, samples) through the sound kernels: one track a row, Arrow batches in, rows out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k

TRACK = "song_id string, sr int, samples array<float>"
MIN_S, MAX_S = 5.0, 480.0


def _rows(tracks: DataFrame, one: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for values in zip(*(batch[c] for c in batch.columns)):
                out = one(dict(zip(batch.columns, values)))
                if out:
                    yield pd.DataFrame(out)[names]

    return tracks.mapInPandas(run, schema)


def usable(tracks: DataFrame, low: float = MIN_S, high: float = MAX_S) -> DataFrame:
    """Tracks of allowed length."""
    s = F.size("samples") / F.col("sr")
    return tracks.where((s >= low) & (s <= high))


def normalized(tracks: DataFrame, peak: float = 0.9) -> DataFrame:
    """Samples scaled to the peak, within -1 to 1; silence stays."""
    top = F.coalesce(F.nullif(F.array_max(F.transform("samples", lambda x: F.abs(x))), F.lit(0.0).cast("float")), F.lit(1.0).cast("float"))
    return tracks.withColumn("samples", F.transform("samples", lambda x: F.least(F.greatest(x / top * F.lit(peak), F.lit(-1.0)), F.lit(1.0)).cast("float")))


def fixed_starts(n: int, sr: int, hop_s: float) -> np.ndarray:
    return np.arange(0, max(n - 1, 1), int(round(hop_s * sr))) / sr


def filled(events: np.ndarray, end: float, hop: float, window: float, gaps: np.ndarray, most: float) -> np.ndarray | None:
    """0 and the events over their gap apart, larger gaps filled by hops, to the end; null of fewer than three usable starts."""
    out = [0.0]
    for e, gap in zip(events.tolist(), gaps.tolist()):
        if e > out[-1] + gap:
            while e - out[-1] > hop * most:
                out.append(out[-1] + hop)
            out.append(e)
    while out[-1] + hop < end - 1e-6:
        out.append(out[-1] + hop)
    kept = [s for s in out if s <= max(0.0, end - 0.35 * window)]
    return np.array(kept) if len(kept) >= 3 else None


def track_starts(y: np.ndarray, sr: int, hop: float, window: float, onsets: bool = True, beats: bool = True) -> np.ndarray:
    """Onsets, else beats (closer ones allowed on bars), else a fixed grid."""
    end = len(y) / sr
    if onsets:
        o = k.onset_times(y, sr, wait=max(1, int(0.04 * sr / 512)))
        if len(o) >= 4 and (s := filled(o, end, hop, window, np.full(len(o), max(0.08, 0.35 * hop)), 1.6)) is not None:
            return s
    if beats:
        b = k.beat_times(y, sr)
        if len(b) >= 8 and (s := filled(b, end, hop, window, np.where(np.arange(len(b)) % 4 == 0, 0.28, 0.45) * hop, 1.7)) is not None:
            return s
    return fixed_starts(len(y), sr, hop)


SEGMENT = "song_id string, segment_idx long, start_s double, end_s double, samples array<float>"


def segments(tracks: DataFrame, window: float = 0.45, hop: float = 0.22, onsets: bool = True, beats: bool = True, variable: bool = False) -> DataFrame:
    """Note-like pieces, padded with zeros at the track's end; the last is the first that reaches it."""
    if window <= 0 or hop <= 0:
        raise ValueError("window and hop must be positive")

    def cut(row: dict) -> list[dict]:
        y, sr = np.asarray(row["samples"], np.float32), int(row["sr"])
        if not len(y):
            return []
        starts = np.round(track_starts(y, sr, hop, window, onsets, beats) * sr).astype(int)
        whole, release, out = int(round(window * sr)), int(round(min(0.08, 0.3 * hop) * sr)), []
        for i, a in enumerate(starts.tolist()):
            if a >= len(y):
                break
            n = int(np.clip(starts[i + 1] - a + release, 0.12 * sr, 2 * whole)) if variable and i + 1 < len(starts) else whole
            out.append({"song_id": row["song_id"], "segment_idx": i, "start_s": a / sr, "end_s": min(a + n, len(y)) / sr, "samples": k.fit_length(y[a : a + n], n)})
            if a + n >= len(y):
                break
        return out

    return _rows(tracks, cut, SEGMENT)


DESCRIBED = "song_id string, segment_idx long, start_s double, end_s double, chroma array<double>, timbre array<double>, energy array<double>, temporal array<double>, register array<double>, level double, head array<double>, tail array<double>"


def described(tracks: DataFrame, window: float = 0.45, hop: float = 0.22, variable: bool = False) -> DataFrame:
    """Descriptors and edge fingerprints of each track's segments, from one spectrum a track."""

    def one(row: dict) -> list[dict]:
        y, sr = np.asarray(row["samples"], float), int(row["sr"])
        if not len(y):
            return []
        starts = track_starts(y, sr, hop, window)
        ends = np.minimum(np.append(starts[1:] + min(0.08, 0.3 * hop), starts[-1] + window) if variable else starts + window, len(y) / sr)
        found = list(k.describe(y, sr, np.stack([starts, ends], 1)))
        edges = k.edge_vectors([y[int(round(d["start_s"] * sr)) : int(round(d["end_s"] * sr))] for d in found], sr)
        return [{**d, "song_id": row["song_id"], "segment_idx": i, "head": head, "tail": tail} for i, (d, head, tail) in enumerate(zip(found, *edges))]

    return _rows(tracks, one, DESCRIBED)


def pitches(tracks: DataFrame) -> DataFrame:
    """Fundamental (Hz, null if none), tuning (cents) and role of each track or clip."""
    return _rows(tracks, lambda r: [{"song_id": r["song_id"], "hz": k.pitch(np.asarray(r["samples"]), int(r["sr"])), "cents": k.tuning_cents(np.asarray(r["samples"]), int(r["sr"])), "role": k.sound_role(np.asarray(r["samples"], float), int(r["sr"]))}], "song_id string, hz double, cents double, role string")


def spectra(tracks: DataFrame, size: int = 2048, hop: int = 512) -> DataFrame:
    """(song_id, frame, magnitude): each track's spectrum, a row a frame."""

    def one(row: dict) -> list[dict]:
        return [{"song_id": row["song_id"], "frame": i, "magnitude": m} for i, m in enumerate(np.abs(k.stft(row["samples"], size, hop)))]

    return _rows(tracks, one, "song_id string, frame long, magnitude array<double>")


def edges(tracks: DataFrame) -> DataFrame:
    """(song_id, head, tail): edge fingerprints of each track or clip."""

    def one(row: dict) -> list[dict]:
        head, tail = k.edge_vectors([row["samples"]], int(row["sr"]))
        return [{"song_id": row["song_id"], "head": head[0], "tail": tail[0]}]

    return _rows(tracks, one, "song_id string, head array<double>, tail array<double>")


def shaped(pairs: DataFrame, how: str, hop: int = 256) -> DataFrame:
    """pairs (song_id, sr, reference, estimate): (song_id, sr, samples), the estimate with the reference's loudness, envelope, transient, colour or detail."""
    kernels = {
        "loudness": lambda y, ref, sr: k.match_loudness(y, ref),
        "envelope": lambda y, ref, sr: k.match_envelope(y, ref, hop=hop),
        "transient": k.match_transient,
        "colour": lambda y, ref, sr: k.match_spectrum(y, ref),
        "detail": lambda y, ref, sr: k.harmonic_reconstruct(y, ref),
    }
    shape = kernels[how]

    def one(r: dict) -> list[dict]:
        y = shape(np.asarray(r["estimate"], float), np.asarray(r["reference"], float), int(r["sr"]))
        return [{"song_id": r["song_id"], "sr": r["sr"], "samples": y}]

    return _rows(pairs, one, "song_id string, sr int, samples array<double>")


def prepared(requests: DataFrame) -> DataFrame:
    """requests (song_id, sr, samples, start_s, n, steps, rate): (song_id, sr, samples), n samples from start_s on, shifted and stretched."""

    def one(r: dict) -> list[dict]:
        y = k.prepared_clip(np.asarray(r["samples"], float), int(r["sr"]), float(r["start_s"]), int(r["n"]), float(r["steps"]), float(r["rate"]))
        return [{"song_id": r["song_id"], "sr": r["sr"], "samples": y}]

    return _rows(requests, one, "song_id string, sr int, samples array<double>")


def quality(pairs: DataFrame) -> DataFrame:
    """pairs (song_id, sr, reference, estimate): log mel distance, harmony likeness, rhythm correlation; to four places."""

    def one(r: dict) -> list[dict]:
        a, b, sr = np.asarray(r["reference"], float), np.asarray(r["estimate"], float), int(r["sr"])
        return [{"song_id": r["song_id"], "log_mel": round(k.log_mel_distance(a, b, sr), 4), "chroma": round(k.frame_chroma_similarity(a, b, sr), 4), "onset": round(k.onset_correlation(a, b, sr), 4)}]

    return _rows(pairs, one, "song_id string, log_mel double, chroma double, onset double")


def reranked(candidates: DataFrame, top_m: int = 3, sure: float = 0.985, margin: float = 0.04, most: int = 160, gain: float = 0.96) -> DataFrame:
    """Candidates (target, t, j, source_id, score, reference, clip), the tile's own first: the nearest in sound takes a doubtful tile.

    Doubtful: the own score below `sure` or hardly above the next; the `most` weakest of a target. A swap needs a distance of at
    most `gain` of the present one. Scores stay as they were.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("target", "t").orderBy("j")
    rows = candidates.withColumns({"own": F.first("score").over(w), "next": F.nth_value("score", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    doubt = F.col("next").isNotNull() & ((F.col("own") < sure) | (F.col("own") - F.col("next") < margin))
    tiles = rows.where(doubt).groupBy("target", "t").agg(F.first("own").alias("own"))
    weak = tiles.withColumn("r", F.row_number().over(Window.partitionBy("target").orderBy("own", "t"))).where(F.col("r") <= most).select("target", "t")
    once = Window.partitionBy("target", "t", "source_id").orderBy("j")
    picked = candidates.join(weak, ["target", "t"]).withColumn("c", F.row_number().over(once)).where("c = 1")
    picked = picked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top_m)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            far = [k.spectral_distance(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(b["reference"], b["clip"])]
            yield pd.DataFrame({"target": b["target"], "t": b["t"], "j": b["j"], "source_id": b["source_id"], "distance": far})

    far = picked.select("target", "t", "j", "source_id", "reference", "clip").mapInPandas(measure, "target string, t long, j long, source_id long, distance double")
    best = far.groupBy("target", "t").agg(F.min_by("source_id", F.struct("distance", "j")).alias("best"), F.min("distance").alias("low"), F.min_by("source_id", "j").alias("now"), F.min_by("distance", "j").alias("high"))
    taken = best.select("target", "t", F.when(F.col("low") <= gain * F.col("high"), F.col("best")).otherwise(F.col("now")).alias("source_id"))
    rest = candidates.where("j = 1").join(weak, ["target", "t"], "left_anti").select("target", "t", "source_id")
    return taken.unionByName(rest)
