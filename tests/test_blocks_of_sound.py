"""Shaping, spectra, grid segments and sound files on waveforms in blocks, against whole-sound kernels."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tessera.functions import kernels
from tessera.operators import audio, index, render, resynthesis, segments, shaping, signals
from tessera.sources import sound

SR, SIZE = 1000, 64


def waves(spark, songs, block=SIZE):
    rows = [(s, "song", 0, [float(v) for v in y]) for s, y in songs.items()]
    return render.wave_blocks(spark.createDataFrame(rows, "song_id string, kind string, piece long, samples array<double>"), block)


def whole(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["song_id"], r["block"])):
        out.setdefault(r["song_id"], []).extend(r["samples"])
    return {k: np.array(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def sounds():
    r = np.random.default_rng(7)
    own = {"a": r.normal(0, 0.3, 1000), "b": r.normal(0, 0.05, 333), "c": np.zeros(200), "d": r.normal(0, 1, 64), "e": r.normal(0, 0.2, 20)}
    ref = {"a": r.normal(0, 0.1, 1500) * np.linspace(0, 1, 1500), "b": r.normal(0, 0.6, 200), "c": r.normal(0, 0.2, 200), "d": np.zeros(64), "e": r.normal(0, 0.5, 50)}
    return own, ref


def padded(ref, n):
    return np.concatenate([ref[:n], np.zeros(max(0, n - len(ref)))])


@pytest.mark.parametrize("how", ["loudness", "attack", "envelope"])
def test_shaping_equals_whole_sounds(spark, sounds, how):
    own, ref = sounds
    y, r = waves(spark, own), waves(spark, ref)
    got = whole({"loudness": lambda: shaping.with_loudness(y, r), "attack": lambda: shaping.with_attack(y, r, SR, size=SIZE), "envelope": lambda: shaping.with_envelope(y, r, hop=16, size=SIZE)}[how]())
    want = {"loudness": lambda a, b: kernels.match_loudness(a, b), "attack": lambda a, b: kernels.match_transient(a, b, SR), "envelope": lambda a, b: kernels.match_envelope(a, padded(b, len(a)), hop=16)}[how]
    assert set(got) == set(own)
    for s in own:
        if how == "envelope" and len(own[s]) < 32:
            continue  # the kernel leaves sounds of less than a frame alone
        np.testing.assert_allclose(got[s], want(own[s], ref[s]), atol=1e-9, err_msg=s)


def test_envelope_needs_whole_hops(spark, sounds):
    with pytest.raises(ValueError):
        shaping.with_envelope(waves(spark, sounds[0]), waves(spark, sounds[1]), hop=48, size=SIZE)


def test_spectra_over_blocks(spark, sounds, monkeypatch):
    monkeypatch.setattr(resynthesis, "FRAMES", 7)
    got = {}
    for r in resynthesis.spectra(waves(spark, sounds[0]), 32, 8, SIZE).collect():
        got.setdefault(r["song_id"], {})[r["frame"]] = r["magnitude"]
    for s, y in sounds[0].items():
        want = np.abs(kernels.stft(y, 32, 8))
        assert sorted(got[s]) == list(range(len(want)))
        np.testing.assert_allclose([got[s][f] for f in range(len(want))], want, atol=1e-9)


@pytest.mark.parametrize("window,hop", [(0.1, 0.04), (0.02, 0.05), (0.333, 0.333)])
def test_grid_segments_equal_tracks_cut_whole(spark, sounds, window, hop):
    tracks = spark.createDataFrame([(s, SR, [float(v) for v in y]) for s, y in sounds[0].items()], audio.TRACK)
    want = {(r["song_id"], r["segment_idx"]): r for r in audio.segments(tracks, window, hop, onsets=False, beats=False).collect()}
    got = {(r["song_id"], r["segment_idx"]): r for r in segments.grid_segments(waves(spark, sounds[0]), SR, window, hop, SIZE).collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert abs(got[k]["start_s"] - r["start_s"]) < 1e-9 and abs(got[k]["end_s"] - r["end_s"]) < 1e-9
        np.testing.assert_allclose(got[k]["samples"], r["samples"], atol=1e-6)


def test_starts_of_dense_and_far_events(spark):
    r = random.Random(3)
    songs = {"a": [r.uniform(0, 50) for _ in range(400)], "b": [0.01 * i for i in range(3000)], "c": [100.0], "d": [0.05]}
    df = spark.createDataFrame([(s, t) for s, ts in songs.items() for t in r.sample(ts, len(ts))], "song_id string, t double").repartition(5)
    got = {}
    for x in signals.event_starts(df, 0.22, 0.08).orderBy("song_id", "place").collect():
        got.setdefault(x["song_id"], []).append(x["start"])
    for s, ts in songs.items():
        out = [0.0]
        for t in sorted(ts):
            if t > out[-1] + 0.08:
                last = out[-1]
                while t - out[-1] > 1.6 * 0.22:
                    out.append(last + 0.22 * (len(out) - out.index(last)))
                out.append(t)
        np.testing.assert_allclose(got[s], out, atol=1e-9)


def test_index_has_edges_of_every_clip(spark):
    r = np.random.default_rng(1)
    clips = {i: r.normal(0, 1, n) for i, n in enumerate((300, 64, 1000, 256))}
    df = spark.createDataFrame([(i, [float(v) for v in y]) for i, y in clips.items()], "source_id long, samples array<double>")
    built = {x["source_id"]: x for x in index.built(spark.createDataFrame([(i,) for i in range(5)], "source_id long"), df, 4000).collect()}
    head, tail = kernels.edge_vectors(list(clips.values()), 4000)
    for i in clips:
        np.testing.assert_allclose(built[i]["head"], head[i])
        np.testing.assert_allclose(built[i]["tail"], tail[i])
    assert built[4]["head"] is None


def test_sound_files_round_trip(spark, tmp_path):
    r = np.random.default_rng(5)
    tracks = {"a": r.normal(0, 1, 500), "b": np.zeros(30), "c": np.array([0.5, -0.25]), "empty": np.zeros(0)}
    df = spark.createDataFrame([(s, 100, [float(v) for v in y]) for s, y in tracks.items()], sound.TRACK).repartition(3)
    folder = str(tmp_path / "sounds")
    sound.write_tracks(df, folder)
    assert (tmp_path / "sounds" / "_SUCCESS").exists() and not list((tmp_path / "sounds").glob(".*-*"))
    got = {x["song_id"]: x for x in sound.read_tracks(spark, folder).collect()}
    assert set(got) == set(tracks)
    for s, y in tracks.items():
        want = y / (np.abs(y).max(initial=0) or 1) * 0.89
        assert got[s]["sr"] == 100 and len(got[s]["samples"]) == len(y)
        np.testing.assert_allclose(got[s]["samples"], want * 32767 / 32768, atol=1 / 32768)
    assert {x["song_id"] for x in sound.read_tracks(spark, folder, 0.2, 4.0).collect()} == {"b"}
    with pytest.raises(Exception, match="holds files"):
        sound.write_tracks(df, folder)
    sound.write_tracks(df.where("song_id = 'c'"), folder, overwrite=True)
    assert [x["song_id"] for x in sound.read_tracks(spark, folder).collect()] == ["c"]


def test_sound_codec():
    y = np.array([0.0, 1.0, -1.0, 0.3])
    sr, back = sound.decoded(sound.encoded(y, 8000, 1.0))
    assert sr == 8000 and np.abs(back - y).max() < 1e-4
    with pytest.raises(Exception):
        sound.decoded(b"no sound")
