"""The factorisation renderer: frames of a target as weighted sums of source frames, turned back into sound.

Spectra are taken and inverted in blocks of FRAMES frames with a frame of halo on either side, as numpy within a group of bounded size;
Spark cuts the samples that a block needs, brings each block its atoms, and adds up the tails of neighbouring blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import fit_length
from ..functions.kernels import hann
from .render import BLOCK, stretches

FRAMES = 256
TINY = 1e-8


def _spectrum(samples: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Spectra of the frames that fill a stretch."""
    return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(samples, size)[::hop] * hann(size), axis=1)


def lengths(waves: DataFrame) -> DataFrame:
    """(song_id, n) of the songs' own sound."""
    return waves.where("kind = 'song'").groupBy("song_id").agg(F.sum(F.size("samples")).cast("long").alias("n_samples"))


def _asked(frames: DataFrame, size: int, hop: int) -> DataFrame:
    """Where frames f0 to f1 (exclusive), centred at every hop, lie in their song."""
    return frames.withColumns({"kind": F.lit("song"), "a": F.col("f0") * hop - size // 2, "n": (F.col("f1") - 1 - F.col("f0")) * hop + size})


def spectra(waves: DataFrame, size: int = 2048, hop: int = 512, block: int = BLOCK) -> DataFrame:
    """(song_id, frame, magnitude) of every frame, centred at every hop."""
    n = lengths(waves).select("song_id", (F.expr(f"n_samples div {hop}") + 1).alias("n_frames"))
    parts = n.withColumn("part", F.explode(F.expr(f"sequence(0L, (n_frames - 1) div {FRAMES})")))
    parts = parts.select("song_id", (F.col("part") * FRAMES).alias("f0"), F.least((F.col("part") + 1) * FRAMES, F.col("n_frames")).alias("f1"))
    cut = stretches(_asked(parts, size, hop), waves, ["song_id", "kind", "a", "n", "f0"], block)

    def magnitudes(batches):
        for b in batches:
            for song, first, samples in zip(*(b.column(c).to_pylist() for c in ("song_id", "f0", "samples"))):
                m = np.abs(_spectrum(np.asarray(samples, float), size, hop))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([song] * len(m)), pa.array(np.arange(first, first + len(m))), lists], names=["song_id", "frame", "magnitude"])

    return cut.select("song_id", "f0", "samples").mapInArrow(magnitudes, "song_id string, frame long, magnitude array<double>")


def _atoms_of(table: pa.Table, size: int, hop: int) -> pa.Table:
    rows = []
    for song, first, wanted, samples in zip(*(table.column(c).to_pylist() for c in ("song_id", "f0", "frames", "samples"))):
        y = np.asarray(samples, float)
        own = np.fft.rfft(np.stack([y[(f - first) * hop : (f - first) * hop + size] for f in wanted]) * hann(size), axis=1)
        own /= np.abs(own).sum(1, keepdims=True) + TINY
        rows += [(song, f, x.real, x.imag) for f, x in zip(wanted, own)]
    columns = zip(*rows) if rows else ([], [], [], [])
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())))], names=["song_id", "frame", "re", "im"])


def selected_atoms(wanted: DataFrame, waves: DataFrame, size: int = 1024, hop: int = 512, block: int = BLOCK) -> DataFrame:
    """(song_id, frame, re, im) of the wanted (song_id, frame), each once: complex spectra whose magnitudes sum to 1 (silence: to 0).

    Frames beyond a song's end are left out when nothing of them is in the song.
    """
    runs = wanted.select("song_id", "frame").distinct().groupBy("song_id", F.expr(f"frame div {FRAMES}").alias("part")).agg(F.sort_array(F.collect_list("frame")).alias("frames"))
    runs = runs.withColumns({"f0": F.element_at("frames", 1), "f1": F.element_at("frames", -1) + 1})
    cut = stretches(_asked(runs, size, hop), waves, ["song_id", "kind", "a", "n", "part", "f0", "frames"], block)

    def atoms(batches):
        for b in batches:
            yield from _atoms_of(pa.Table.from_batches([b]), size, hop).to_batches()

    return cut.select("song_id", "f0", "frames", "samples").mapInArrow(atoms, "song_id string, frame long, re array<double>, im array<double>")


def shaped(magnitude: np.ndarray, energy: np.ndarray, smoothing: float) -> np.ndarray:
    """Frames' shapes smoothed over neighbours (1/4, 1/2, 1/4, ends repeated), at the frames' energies."""
    part = lambda x: x / np.maximum(x.sum(1, keepdims=True), TINY)
    shape = part(magnitude)
    padded = np.pad(shape, ((1, 1), (0, 0)), mode="edge")
    smooth = 0.25 * padded[:-2] + 0.5 * shape + 0.25 * padded[2:]
    return part((1 - smoothing) * shape + smoothing * smooth) * energy[:, None]


def coherent(magnitude: np.ndarray, energy: np.ndarray, reference: np.ndarray, blend: float) -> np.ndarray:
    """Magnitudes drawn towards a reference's shape, more where the two differ, by half to twice at most: a bin of 0 stays 0."""
    ref = np.abs(reference)
    alike = (magnitude * ref).sum(1) / (np.linalg.norm(magnitude, axis=1) * np.linalg.norm(ref, axis=1) + TINY)
    amount = blend * (0.35 + 0.65 * (1 - np.clip(alike, 0, 1)))
    part = lambda x: x / np.maximum(x.sum(1, keepdims=True), TINY)
    ratio = np.clip(part(ref) / np.maximum(part(magnitude), TINY), 0.5, 2.0)
    out = magnitude * ratio ** amount[:, None]
    return out * (energy / np.maximum(out.sum(1), TINY))[:, None]


PARTS = "target string, block long, y array<double>, w array<double>"


def _block_sound(table: pa.Table, size: int, hop: int, smoothing: float, blend: float, block: int) -> pa.Table:
    """The windowed sound of one block of frames, and the squares of its windows, by blocks of samples."""
    kind = table.column("row").to_numpy()
    column = lambda c: table.column(c)
    own = int(np.flatnonzero(kind == 0)[0])
    target, first, last, low, high = (column(c)[own].as_py() for c in ("target", "f0", "f1", "low", "high"))
    energy = np.abs(_spectrum(np.asarray(column("x")[own].as_py(), float), size, hop)).sum(1)
    picks = np.flatnonzero(kind == 2)
    mixed, magnitude = np.zeros((last - first, size // 2 + 1), complex), np.zeros((last - first, size // 2 + 1))
    if len(picks):
        some = table.take(pa.array(picks))
        order = np.lexsort((some.column("slot").to_numpy(), some.column("t").to_numpy()))
        t, h = some.column("t").to_numpy()[order] - first, some.column("h").to_numpy()[order]
        re, im = (np.stack(some.column(c).combine_chunks().to_numpy(zero_copy_only=False))[order] for c in ("x", "z"))
        np.add.at(mixed, t, (re + 1j * im) * h[:, None])
        np.add.at(magnitude, t, np.hypot(re, im) * h[:, None])
    magnitude = shaped(magnitude, energy, smoothing)
    phase = np.angle(mixed)
    given = np.flatnonzero(kind == 1)
    if len(given):
        reference = _spectrum(np.asarray(column("x")[int(given[0])].as_py(), float), size, hop)
        magnitude, phase = coherent(magnitude, energy, reference, blend), np.angle(reference)
    keep = slice(low - first, high - first)
    frames = np.fft.irfft((magnitude * np.exp(1j * phase))[keep], size, axis=1) * hann(size)
    start, n = low * hop - size // 2, (high - low - 1) * hop + size
    begin = start // block * block
    length = -(-(start + n - begin) // block) * block
    y, w = np.zeros(length), np.zeros(length)
    for i, f in enumerate(frames):
        a = start - begin + i * hop
        y[a : a + size] += f
        w[a : a + size] += hann(size) ** 2
    rows = [(target, b, y[p : p + block], w[p : p + block]) for p in range(0, length, block) if (b := (begin + p) // block) >= 0]
    lists = pa.list_(pa.float64())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), lists, lists))], names=["target", "block", "y", "w"])


def resynthesised(picks: DataFrame, targets: DataFrame, sources: DataFrame, size: int = 1024, hop: int = 512, smoothing: float = 0.28, reference: DataFrame | None = None, blend: float = 0.16, block: int = BLOCK, ceiling: float = 0.99) -> DataFrame:
    """(target, block, samples): the targets' sound from source frames. picks: (target, t, slot, song_id, frame, h); a frame without picks takes its neighbours' shape.

    targets, sources, reference: waveforms in blocks (see render); a target is its song_id. Each frame's magnitudes are the picks' weighted sum,
    smoothed, at the target frame's energy. Phases are the weighted sum's, or the reference's, which then shapes magnitudes a
    little. Nothing of the target's or reference's sound gets in: silent sources stay silent. Peaks end at the ceiling.
    """
    songs = lengths(targets)
    n = songs.select(F.col("song_id").alias("target"), F.col("song_id"), (F.expr(f"n_samples div {hop}") + 1).alias("n_frames"))
    parts = n.withColumn("part", F.explode(F.expr(f"sequence(0L, (n_frames - 1) div {FRAMES})")))
    parts = parts.withColumns({"low": F.col("part") * FRAMES, "high": F.least((F.col("part") + 1) * FRAMES, F.col("n_frames"))})
    parts = parts.withColumns({"f0": F.greatest(F.lit(0), F.col("low") - 1), "f1": F.least(F.col("high") + 1, F.col("n_frames"))})
    keys = ["song_id", "kind", "a", "n", "target", "part", "f0", "f1", "low", "high"]
    none = F.array().cast("array<double>")
    sound = lambda row, waves: stretches(_asked(parts, size, hop), waves, keys, block).select("target", "part", F.lit(row).alias("row"), "f0", "f1", "low", "high", F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("slot"), F.lit(0.0).alias("h"), F.col("samples").alias("x"), none.alias("z"))
    rows = sound(0, targets)
    if reference is not None:
        rows = rows.unionByName(sound(1, reference))
    atoms = selected_atoms(picks.where("h > 0"), sources, size, hop, block)
    used = picks.where("h > 0").join(n.select("target", "n_frames"), "target").where("t < n_frames").join(atoms, ["song_id", "frame"])
    own = F.expr(f"t div {FRAMES}")
    halo = F.filter(F.array(own, F.when((F.col("t") % FRAMES == 0) & (own > 0), own - 1), F.when((F.col("t") % FRAMES == FRAMES - 1) & (F.col("t") + 1 < F.col("n_frames")), own + 1)), lambda p: p.isNotNull())
    zero = F.lit(0).cast("long")
    used = used.select("target", F.explode(halo).alias("part"), F.lit(2).alias("row"), *(zero.alias(c) for c in ("f0", "f1", "low", "high")), F.col("t").cast("long").alias("t"), F.col("slot").cast("long").alias("slot"), "h", F.col("re").alias("x"), F.col("im").alias("z"))

    def one(table: pa.Table) -> pa.Table:
        return _block_sound(table, size, hop, smoothing, blend, block)

    made = rows.unionByName(used).groupBy("target", "part").applyInArrow(one, PARTS)
    # a block of samples has the tails of few blocks of frames
    sums = made.groupBy("target", "block").agg(F.array_sort(F.collect_list(F.struct("y", "w"))).alias("parts"))
    zeros = F.array_repeat(F.lit(0.0), block)
    add = lambda c: F.aggregate("parts", zeros, lambda s, p: F.zip_with(s, p[c], lambda x, y: x + y))
    sums = sums.select("target", "block", F.zip_with(add("y"), add("w"), lambda y, w: y / F.greatest(w, F.lit(TINY))).alias("y"))
    left = F.col("n_samples") - F.col("block") * block
    out = sums.join(songs.withColumnRenamed("song_id", "target"), "target").where(left > 0).select("target", "block", fit_length("y", F.least(left, F.lit(block))).alias("y"))
    top = out.groupBy("target").agg(F.max(F.array_max(F.transform("y", lambda x: F.abs(x)))).alias("top"))
    limited = F.when(F.col("top") > ceiling, F.transform("y", lambda x: x * (ceiling / F.col("top")))).otherwise(F.col("y"))
    return out.join(top, "target").select("target", "block", limited.alias("samples"))


def frame_picks(act: DataFrame, sr: int, hop: int = 512) -> DataFrame:
    """(target, t, song_id, source_s, weight): the strongest pick of each frame, the first of equal ones. act: (target, t, slot, song_id, frame, h)."""
    best = act.groupBy("target", "t").agg(F.min_by(F.struct("song_id", "frame", "h"), F.struct((-F.col("h")).alias("h"), "slot")).alias("b"))
    return best.select("target", "t", "b.song_id", (F.col("b.frame") * hop / sr).alias("source_s"), F.col("b.h").alias("weight"))
