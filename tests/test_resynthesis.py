"""The factorisation renderer against whole-signal loops, over blocks of frames and of samples."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.functions import kernels
from tessera.operators import render, resynthesis

SIZE, HOP, BLOCK = 32, 8, 64


def waves(spark, songs, block=BLOCK):
    rows = [(s, "song", 0, [float(v) for v in y]) for s, y in songs.items()]
    return render.wave_blocks(spark.createDataFrame(rows, "song_id string, kind string, piece long, samples array<double>"), block)


def picks_of(spark, rows):
    return spark.createDataFrame(rows, "target string, t long, slot long, song_id string, frame long, h double")


def sound(df, target, n, block=BLOCK):
    out = np.full(n, np.nan)
    for r in df.where(f"target = '{target}'").collect():
        out[r["block"] * block : r["block"] * block + len(r["samples"])] = r["samples"]
    return out


def plain(target, songs, picks, smoothing, reference, blend, size=SIZE, hop=HOP):
    spectra = {s: kernels.stft(y, size, hop) for s, y in songs.items()}
    goal = np.abs(kernels.stft(target, size, hop)).sum(1)
    mixed, magnitude = np.zeros((len(goal), size // 2 + 1), complex), np.zeros((len(goal), size // 2 + 1))
    for t, _, song, frame, h in picks:
        if t < len(goal) and frame < len(spectra[song]):
            x = spectra[song][frame] / (np.abs(spectra[song][frame]).sum() + 1e-8)
            mixed[t] += h * x
            magnitude[t] += h * np.abs(x)
    part = lambda x: x / np.maximum(x.sum(1, keepdims=True), 1e-8)
    s = part(magnitude)
    p = np.pad(s, ((1, 1), (0, 0)), mode="edge")
    m = part((1 - smoothing) * s + smoothing * (p[:-2] / 4 + s / 2 + p[2:] / 4)) * goal[:, None]
    phase = np.angle(mixed)
    if reference is not None:
        r = kernels.stft(reference, size, hop)
        alike = (m * abs(r)).sum(1) / (np.linalg.norm(m, axis=1) * np.linalg.norm(r, axis=1) + 1e-8)
        m = m * np.exp(blend * (0.35 + 0.65 * (1 - np.clip(alike, 0, 1)))[:, None] * np.log(np.clip(part(abs(r)) / np.maximum(part(m), 1e-8), 0.5, 2)))
        m *= (goal / np.maximum(m.sum(1), 1e-8))[:, None]
        phase = np.angle(r)
    y = kernels.istft(m * np.exp(1j * phase), hop, len(target))
    return y * min(1, 0.99 / max(np.abs(y).max(), 1e-9))


@pytest.fixture(scope="module")
def made():
    r = np.random.default_rng(4)
    songs = {"A": r.normal(0, 0.2, 1500), "B": np.sin(np.arange(4000) / 3) * 0.4}
    targets = {"T": r.normal(0, 0.3, 5000), "U": r.normal(0, 0.1, 100), "V": r.normal(0, 0.1, 8 * 257)}
    rows = []
    for name, y in targets.items():
        for t in range(len(y) // HOP + 1):
            if t % 11 != 5:
                own = [(name, t, k, "AB"[int(r.integers(2))], int(r.integers(0, 187)), float(r.random())) for k in range(3)]
                rows += [(*o[:5], o[5] / sum(x[5] for x in own)) for o in own]
    rows += [("T", 9999, 0, "A", 3, 1.0), ("T", 3, 7, "A", 99999, 0.5), ("T", 4, 8, "A", 5, 0.0), ("none", 0, 0, "A", 0, 1.0)]
    return songs, targets, rows


@pytest.mark.parametrize("smoothing,with_reference", [(0.28, False), (0.0, False), (0.28, True)])
def test_blocks_make_no_difference(spark, made, smoothing, with_reference):
    songs, targets, rows = made
    reference = {k: np.roll(v, 7)[::-1].copy() for k, v in targets.items()} if with_reference else None
    got = resynthesis.resynthesised(picks_of(spark, rows), waves(spark, targets), waves(spark, songs), SIZE, HOP, smoothing, waves(spark, reference) if reference else None, 0.16, BLOCK).cache()
    for name, y in targets.items():
        own = [r[1:] for r in rows if r[0] == name and r[5] > 0]
        want = plain(y, songs, own, smoothing, reference[name] if reference else None, 0.16)
        np.testing.assert_allclose(sound(got, name, len(y)), want, atol=1e-7, err_msg=name)
    assert got.where("target = 'none'").count() == 0


def test_atoms_are_frames_of_the_whole_song(spark, made):
    songs = made[0]
    wanted = spark.createDataFrame([("A", 0), ("A", 187), ("A", 60), ("A", 60), ("B", 300), ("B", 499), ("C", 1)], "song_id string, frame long")
    got = {(r["song_id"], r["frame"]): np.array(r["re"]) + 1j * np.array(r["im"]) for r in resynthesis.selected_atoms(wanted, waves(spark, songs), SIZE, HOP, BLOCK).collect()}
    assert set(got) == {("A", 0), ("A", 187), ("A", 60), ("B", 300), ("B", 499)}
    for (s, f), x in got.items():
        want = kernels.stft(songs[s], SIZE, HOP)[f]
        np.testing.assert_allclose(x, want / (np.abs(want).sum() + 1e-8), atol=1e-12)


def test_silent_sources_stay_silent(spark):
    t = 0.25 * np.sin(np.arange(2000) / 2)
    rows = [("T", i, 0, "A", i, 1.0) for i in range(251)]
    for reference in (None, waves(spark, {"T": t})):
        got = resynthesis.resynthesised(picks_of(spark, rows), waves(spark, {"T": t}), waves(spark, {"A": np.zeros(2000)}), SIZE, HOP, reference=reference, block=BLOCK)
        assert np.abs(sound(got, "T", 2000)).max() < 1e-7


def test_a_song_is_rebuilt_from_itself(spark):
    t = np.arange(8000) / 8000
    y = 0.25 * np.sin(2 * np.pi * 220 * t) + 0.2 * np.sin(2 * np.pi * 330 * t)
    rows = [("T", i, 0, "A", i, 1.0) for i in range(63)]
    got = sound(resynthesis.resynthesised(picks_of(spark, rows), waves(spark, {"T": y}, 1024), waves(spark, {"A": y}, 1024), 512, 128, block=1024), "T", 8000, 1024)
    assert kernels.frame_chroma_similarity(y, got, 8000) > 0.95 and np.corrcoef(y[600:7400], got[600:7400])[0, 1] > 0.95


def test_strongest_picks(spark):
    got = resynthesis.frame_picks(picks_of(spark, [("T", 0, 1, "A", 10, 0.5), ("T", 0, 0, "B", 4, 0.5), ("T", 1, 0, "A", 2, 0.1), ("T", 1, 1, "A", 3, 0.9)]), 1000, 50)
    assert sorted(map(tuple, got.collect())) == [("T", 0, "B", 0.2, 0.5), ("T", 1, "A", 0.15, 0.9)]
