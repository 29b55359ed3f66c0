"""Behaviour of search and decoding on hand-made descriptors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.costs import MatchParams
from tessera.operators import decode, factorize, search

SCHEMA = "source_id long, song_id string, segment_idx long, start_s double, end_s double, chroma array<double>, temporal array<double>, timbre array<double>, energy array<double>, register array<double>, level double"


def one(n, i, value=1.0):
    return [value if k == i else 0.0 for k in range(n)]


def row(i, song, idx, chroma, timbre=None, energy=None, start=None, length=1.0, temporal=None, register=None, level=None):
    start = 0.5 * idx if start is None else start
    return (i, song, idx, start, start + length, chroma, temporal, timbre or one(8, 0), energy or one(4, 0), register, level)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_shift_is_found_and_ties_go_to_the_smaller_id(spark):
    sources = frame(spark, [row(7, "A", 1, one(12, 0)), row(3, "A", 2, one(12, 0))])
    targets = frame(spark, [row(100, "T5", 1, one(12, 2))])
    got = search.beam_topk(targets, sources, 2).orderBy("j").collect()
    assert [(r["source_id"], r["key_shift"]) for r in got] == [(3, 2), (7, 2)]


def test_diverse_beam_covers_songs(spark):
    rows = [row(10 * s + i, "ABC"[s], i + 1, one(12, s)) for s in range(3) for i in range(4)]
    got = search.beam_diverse(frame(spark, [row(100, "T5", 1, one(12, 0))]), frame(spark, rows), 6, 2).collect()
    assert {r["song_id"] for r in got} == {"A", "B", "C"} and len(got) == 6


def test_temporal_and_register_break_ties(spark):
    up, down = one(48, 0)[:24] + one(24, 3), one(24, 3) + one(24, 0)
    rows = [row(0, "A", 1, one(12, 0), temporal=down, register=[0.0, 0.0, 1.0]), row(1, "A", 2, one(12, 0), temporal=up, register=[1.0, 0.0, 0.0])]
    t = frame(spark, [row(100, "T5", 1, one(12, 0), temporal=up, register=[1.0, 0.0, 0.0])])
    assert search.beam_topk(t, frame(spark, rows), 1).first()["source_id"] == 1


def test_empty_sides(spark):
    t, none = frame(spark, [row(100, "T5", 1, one(12, 0))]), frame(spark, [])
    assert search.beam_topk(t, none, 3).count() == 0
    assert search.beam_topk(none, t, 3).count() == 0


@pytest.fixture
def duel(spark):
    """Two songs, and targets that alternate which of them is a little nearer."""
    a, b = one(12, 0), one(12, 5)
    sources = frame(spark, [row(i, "A", i + 1, a, start=0.5 * i) for i in range(10)] + [row(10 + i, "B", i + 1, b, start=0.5 * i) for i in range(10)])
    mixed = [np.array(a) * x + np.array(b) * y for x, y in ((1.0, 0.9), (0.9, 1.0))]
    targets = frame(spark, [row(100 + t, "T5", t + 1, (mixed[t % 2] / np.linalg.norm(mixed[t % 2])).tolist(), start=0.5 * t) for t in range(8)])
    beam = []
    for t in range(8):
        for j in range(20):
            song = "A" if j < 10 else "B"
            beam.append(("T5", t + 1, j + 1, j, song, 0.95 if (song == "A") == (t % 2 == 0) else 0.93, 0))
    return spark.createDataFrame(beam, "target string, t long, j long, source_id long, song_id string, score double, key_shift int"), targets, sources


def test_continuity_beats_greedy(duel):
    beam, targets, sources = duel
    p = MatchParams(lambda_switch=1.2, hop_s=0.5)
    local = decode.local_costs(beam, targets, sources, p).select("target", "t", "j", "local")
    path = decode.cheapest_path(local, decode.step_costs(beam, targets, sources, p)).join(beam, ["target", "t", "j"])
    assert decode.transitions(path).first()["transitions"] <= 2
    greedy = beam.groupBy("target", "t").agg(F.max_by("song_id", "score").alias("song_id"))
    assert decode.transitions(greedy).first()["transitions"] >= 5


def test_path_equals_plain_search(spark):
    rng = np.random.default_rng(1)
    local, step = rng.random((5, 3)), rng.random((5, 3, 3))
    rows = [("T5", t + 1, j + 1, float(local[t, j])) for t in range(5) for j in range(3)]
    steps = [("T5", t + 1, i + 1, j + 1, float(step[t, i, j])) for t in range(1, 5) for i in range(3) for j in range(3)]
    got = decode.cheapest_path(spark.createDataFrame(rows, "target string, t long, j long, local double"), spark.createDataFrame(steps, "target string, t long, i long, j long, cost double"))
    best = min((sum(local[t, p[t]] for t in range(5)) + sum(step[t, p[t - 1], p[t]] for t in range(1, 5)), p) for p in np.ndindex(3, 3, 3, 3, 3))
    out = got.orderBy("t").collect()
    assert tuple(r["j"] - 1 for r in out) == best[1] and abs(out[-1]["cost"] - best[0]) < 1e-6


def test_share_quota_and_island(spark, duel):
    beam, _, sources = duel
    tiles = beam.where("j = 1")
    swapped = decode.enforce_max_share(tiles, beam, sources, 0.5).toPandas()
    assert (swapped["song_id"] == "A").mean() <= 0.5 and len(swapped) == 8
    rows = [("T5", t + 1, (t if s == "A" else 10 + t) % 20, s, 0.5 * t, 0.9, 0) for t, s in enumerate("AAABAAAA")]
    df = spark.createDataFrame(rows, "target string, t long, source_id long, song_id string, start_s double, score double, key_shift int")
    out = decode.enforce_min_runs(df, sources, 3, 0.5, 1.0).orderBy("t").toPandas()
    assert set(out["song_id"]) == {"A"} and abs(out.loc[3, "score"] - 0.9 * 0.98) < 1e-9


def test_layers_sum_to_one_and_songs_differ(spark):
    mixed = [np.array(one(12, s)) * 0.5 + np.array(one(12, 0)) * 0.85 for s in range(3)]
    rows = [row(10 * s + i, "ABC"[s], i + 1, (mixed[s] / np.linalg.norm(mixed[s])).tolist()) for s in range(3) for i in range(3)]
    sources, targets = frame(spark, rows), frame(spark, [row(100, "T5", 1, one(12, 0))])
    beam = search.beam_topk(targets, sources, 9)
    got = decode.layers(beam.where("j = 1"), beam, targets, sources, MatchParams(n_layers=3)).toPandas()
    assert abs(got["weight"].sum() - 1) < 1e-9 and got["song_id"].is_unique and len(got) > 1
    pct = decode.contributions(decode.layers(beam.where("j = 1"), beam, targets, sources, MatchParams(n_layers=3)), ("A", "B", "C", "D")).toPandas()
    assert len(pct) == 4 and abs(pct["pct"].sum() - 100) < 0.3


def test_nearest_clip_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    sources = frame(spark, [row(i, "AB"[i % 2], i, one(12, 0), start=float(rng.integers(0, 20)) / 2) for i in range(30)])
    want = spark.createDataFrame([("AB"[i % 2], i, float(x)) for i, x in enumerate(rng.integers(-4, 50, 40) / 4)], "song_id string, n int, want double")
    got = {r["n"]: r["source_id"] for r in decode.nearest_clip(want, sources).collect()}
    s = sources.collect()
    for r in want.collect():
        best = min((abs(x["start_s"] - r["want"]), x["start_s"], x["source_id"]) for x in s if x["song_id"] == r["song_id"])
        assert got[r["n"]] == best[2]


def test_learned_activations(spark):
    shapes = [one(4, i) for i in range(3)]
    rows = []
    for t in range(6):
        goal = [0.5, 0.5, 0.0, 0.0] if t < 3 else [0.0, 0.5, 0.5, 0.0]
        rows += [("T5", t + 1, j + 1, j, "ABC"[j], t, shapes[j], goal) for j in range(3)]
    df = spark.createDataFrame(rows, "target string, t long, slot long, source_id long, song_id string, frame long, shape array<double>, goal array<double>")
    got = factorize.learn(df).toPandas()
    sums = got.groupby("t")["h"].sum()
    assert np.allclose(sums, 1)
    assert got[(got["t"] == 1) & (got["source_id"] == 2)]["h"].iloc[0] < 0.05
