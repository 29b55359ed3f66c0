"""Sound kernels on tones, clicks and silence."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.functions import kernels as k
from tessera.operators import audio

SR = 22050


def tone(hz, s=1.0, sr=SR, a=0.5):
    return a * np.sin(2 * np.pi * hz * np.arange(int(s * sr)) / sr)


def clicks(times, s=2.0, sr=SR):
    y = np.zeros(int(s * sr))
    for t in times:
        i = int(t * sr)
        y[i : i + 200] += np.exp(-np.arange(200) / 30) * np.sin(np.arange(200))[: len(y[i : i + 200])]
    return y


def test_spectrum_round_trip():
    y = tone(440) + 0.1 * np.random.default_rng(1).standard_normal(SR)
    assert np.abs(k.istft(k.stft(y, 1024, 256), 256, len(y)) - y).max() < 1e-6


@pytest.mark.parametrize("hz", [110.0, 220.0, 440.0, 987.77])
def test_pitch_of_tones(hz):
    assert abs(12 * np.log2(k.pitch(tone(hz), SR) / hz)) < 0.2
    assert k.pitch(np.zeros(SR), SR) is None


def test_pitch_class_and_tuning():
    assert k.chroma(tone(440), SR)[20].argmax() == 9
    assert abs(k.tuning_cents(tone(440), SR)) <= 3
    assert abs(k.tuning_cents(tone(440 * 2 ** (20 / 1200)), SR) - 20) <= 4


def test_shift_and_stretch():
    y = tone(220)
    assert abs(12 * np.log2(k.pitch(k.pitch_shift(y, 5), SR) / 220) - 5) < 0.3 and len(k.pitch_shift(y, 5)) == len(y)
    longer = k.time_stretch(y, 0.5)
    assert abs(len(longer) - 2 * len(y)) < 2 and abs(12 * np.log2(k.pitch(longer, SR) / 220)) < 0.3
    assert len(k.prepared_clip(y, SR, 0.9, 5000, 2, 1.2)) == 5000


def test_onsets_are_near_clicks():
    times = np.array([0.4, 0.8, 1.2, 1.6])
    got = k.onset_times(clicks(times), SR)
    assert len(got) >= 4 and all(np.abs(got - t).min() < 0.08 for t in times)
    assert len(k.onset_times(np.zeros(SR), SR)) == 0


def test_filters_pass_and_stop():
    low, high = tone(60), tone(4000)
    assert k.rms(k.zero_phase(low + high, SR, 400, "low") - low) < 0.02
    assert k.rms(k.zero_phase(low + high, SR, 400, "high") - high) < 0.02


def test_shaping():
    y, ref = tone(300, a=0.1), tone(300, a=0.4)
    assert abs(k.rms(k.match_loudness(y, ref, 1.0)) / k.rms(ref) - 0.875) < 0.2
    decay = tone(300) * np.linspace(1, 0.05, SR)
    shaped = k.match_envelope(tone(300), decay)
    assert k.rms(shaped[:4000]) > 2 * k.rms(shaped[-4000:])
    assert abs(k.onset_peak(k.align_onset(clicks([0.3], 1), clicks([0.32], 1), SR), SR) - 0.32 * SR) < 600
    for f in (lambda: k.match_spectrum(y, ref), lambda: k.harmonic_reconstruct(y, ref), lambda: k.residual_fill(y, ref, ref), lambda: k.match_transient(y, ref, SR)):
        assert len(f()) == len(y) and np.isfinite(f()).all()


def test_distances():
    a, b = tone(440), tone(523.25)
    assert k.log_mel_distance(a, a, SR) == 0 and k.log_mel_distance(a, b, SR) > 0.1
    assert k.frame_chroma_similarity(a, a, SR) > 0.999 > 0.8 > k.frame_chroma_similarity(a, b, SR)
    assert k.spectral_distance(a, a) == 0 and k.spectral_distance(a[:100], a) == float("inf")
    assert k.onset_correlation(clicks([0.4, 1.1]), clicks([0.4, 1.1]), SR) > 0.99
    assert abs(np.linalg.norm(k.edge_vectors([a], SR)[0]) - 1) < 1e-6


def test_roles():
    assert k.sound_role(tone(60), SR) == "bass"
    assert k.sound_role(clicks(np.arange(0.1, 1.9, 0.12)), SR) == "drums"
    assert k.sound_role(tone(600) + tone(900), SR) == "harmonic"


def test_silent_atoms_give_silence():
    out = k.synthesize(np.zeros((2, 513)), [[(0, 0.5)]] * 8, np.ones(8), np.zeros((8, 513)), 256, 1500)
    assert np.abs(out).max() < 1e-7


def tracks(spark, *songs):
    return spark.createDataFrame([(n, SR, [float(v) for v in y]) for n, y in songs], audio.TRACK)


def test_segments(spark):
    df = tracks(spark, ("silent", np.zeros(int(1.2 * SR))), ("none", []), ("clicks", clicks([0.3, 0.65, 1.2, 1.55])))
    got = audio.segments(df, 0.5, 0.25).toPandas()
    silent = got[got["song_id"] == "silent"]
    assert len(silent) == 4 and {len(x) for x in silent["samples"]} == {11025}
    assert "none" not in set(got["song_id"])
    free = audio.segments(df.where("song_id = 'clicks'"), 0.5, 0.25, variable=True).toPandas()
    assert free["samples"].map(len).nunique() > 1


def test_described_and_pitches(spark):
    df = tracks(spark, ("a", tone(440, 2)), ("b", tone(110, 2)))
    got = audio.described(audio.normalized(df)).toPandas()
    for c in ("chroma", "timbre", "energy", "temporal", "register", "head"):
        assert np.allclose([np.linalg.norm(v) for v in got[c]], 1, atol=1e-5)
    assert got["level"].between(0, 1).all()
    hz = audio.pitches(df).toPandas().set_index("song_id")["hz"]
    assert abs(hz["a"] - 440) < 5 and abs(hz["b"] - 110) < 2


def test_rerank_swaps_only_doubtful_tiles(spark):
    good, bad = tone(300, 0.3) + tone(3000, 0.3, a=0.2), tone(300, 0.3)
    rows = [("T", 1, 1, 10, 0.9, good.tolist(), bad.tolist()), ("T", 1, 2, 11, 0.89, good.tolist(), good.tolist()), ("T", 2, 1, 10, 0.99, good.tolist(), bad.tolist()), ("T", 2, 2, 11, 0.8, good.tolist(), good.tolist())]
    df = spark.createDataFrame(rows, "target string, t long, j long, source_id long, score double, reference array<double>, clip array<double>")
    assert {r["t"]: r["source_id"] for r in audio.reranked(df).collect()} == {1: 11, 2: 10}
