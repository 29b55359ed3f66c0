"""The unit renderer, numbering and onsets on made signals, against plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, numbering, onsets, render, segments

SR, SIZE = 1000, 128


def waves(spark, songs, size=SIZE):
    rows = []
    for song, kinds in songs.items():
        for kind, y in (kinds if isinstance(kinds, dict) else {"song": kinds}).items():
            cuts = sorted(random.Random(len(y)).sample(range(1, len(y)), 5))
            rows += [(song, kind, i, [float(v) for v in y[a:b]]) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(y)]))]
    return render.wave_blocks(spark.createDataFrame(rows, "song_id string, kind string, piece long, samples array<double>").repartition(3), size)


def tiles_of(spark, rows):
    return spark.createDataFrame(rows, "target string, place long, start_s double, duration_s double, song_id string, source_s double")


def layers_of(spark, rows):
    return spark.createDataFrame(rows, "target string, place long, layer long, song_id string, role string, source_s double, weight double")


def sound(df, n, target="T"):
    out = np.zeros(n)
    for r in df.where(F.col("target") == target).collect():
        out[r["at"]] = r["y"]
    return out


def plain_render(tiles, mixes, sr, window_s, ends):
    """The same by loops over samples; tiles: (start_s, duration_s, song, source_s), mixes by length."""
    guard = max(16, round(0.004 * sr))
    pos = [int(np.rint(t[0] * sr)) for t in tiles]
    win = [int(np.rint(min(max(t[1], 0.12), 2 * window_s) * sr)) for t in tiles]
    span = [max(1, b - a) for a, b in zip(pos, pos[1:])] + [win[-1]]
    fade = [max(min(round(0.03 * sr), a // 2, b // 2), min(guard, a, b)) for a, b in zip(span, span[1:])] + [0]
    for i in range(len(tiles) - 1):
        if ends is not None and min(abs(o - pos[i + 1]) for o in ends) <= round(0.02 * sr):
            short = max(guard, int(np.rint(min(round(0.03 * sr), span[i] // 2, span[i + 1] // 2) * 0.35)))
            fade[i] = min(fade[i], max(1, min(short, span[i], span[i + 1])))
    n = int(np.rint((tiles[-1][0] + window_s) * sr))
    s, w, w2, ease = (np.zeros(n + max(win) + max(span) + 200) for _ in range(4))
    for i, p in enumerate(pos):
        length = max(win[i], span[i] + fade[i])
        mix = mixes(i, length)
        fin = fade[i - 1] if i else 0
        for k in range(length):
            e = math.sin(math.pi / 2 * k / fin) if k < fin else 1.0
            left = length - fade[i]
            if k >= left:
                e *= 1.0 if fade[i] <= 1 else math.cos(math.pi / 2 * (k - left) / (fade[i] - 1))
            s[p + k] += e * mix[k]
            w[p + k] += e
            w2[p + k] += e * e
        if i:
            step = max(1, p - pos[i - 1]) / sr
            on = tiles[i][2] == tiles[i - 1][2] and abs(tiles[i - 1][3] + step - tiles[i][3]) <= max(0.06, 0.55 * step)
            if not on:
                for k in range(fin):
                    ease[p + k] = math.sin(math.pi * k / max(1, fin - 1)) ** 2
    d = (1 - ease) * w + ease * np.sqrt(np.maximum(w2, 1e-12))
    y = np.where(d > 1e-6, s / np.where(d > 1e-6, d, 1), s)[:n]
    g = min(guard, n // 2)
    for k in range(g):
        r = math.sin(math.pi / 2 * k / (g - 1))
        y[k] *= r
        y[n - 1 - k] *= r
    top = np.abs(y).max()
    return y * 0.99 / top if top > 0.99 else y


def fit(y, n):
    return np.concatenate([y[:n], np.zeros(max(0, n - len(y)))])


def test_blocks_hold_the_song(spark):
    y = np.arange(1000.0)
    got = sorted(waves(spark, {"A": y, "B": y[:300] * 2}).collect(), key=lambda r: (r["song_id"], r["block"]))
    a = [r for r in got if r["song_id"] == "A"]
    assert [r["block"] for r in a] == list(range(8)) and {len(r["samples"]) for r in a[:-1]} == {SIZE}
    assert sum((r["samples"] for r in a), []) == y.tolist()
    assert sum((r["samples"] for r in got if r["song_id"] == "B"), []) == (y[:300] * 2).tolist()


def test_clips_of_songs_and_stems(spark):
    y = np.sin(np.arange(900.0))
    stems = {"song": y, "drums": y + 1, "bass": y + 2, "other": y + 3, "vocals": y + 4}
    asked = [("A", role, a, n, i) for i, (role, a, n) in enumerate([("full", 0, 900), ("drums", 100, 300), ("bass", 127, 2), ("harmonic", 850, 120), ("odd", 5, 1), ("drums", 100, 300)])]
    asked += [("B", "drums", 700, 400, 10), ("B", "full", 2000, 30, 11), ("none", "full", 0, 10, 12)]
    df = spark.createDataFrame(asked, "song_id string, role string, a long, n long, id long")
    got = {r["id"]: np.array(r["samples"]) for r in render.layer_clips(df, waves(spark, {"A": stems, "B": y}), SIZE).collect()}
    want = {0: 0.5 * (4 * y + 10), 1: y[100:400] + 1, 2: y[127:129] + 2, 3: fit(0.65 * (y[850:] + 3) + 0.35 * (y[850:] + 4), 120), 4: (0.5 * (4 * y + 10))[5:6], 5: y[100:400] + 1, 10: fit(y[700:], 400), 11: np.zeros(30), 12: np.zeros(10)}
    assert set(got) == set(want)
    for k, v in want.items():
        np.testing.assert_allclose(got[k], v, atol=1e-12)


def test_equal_requests_are_cut_once(spark):
    df = spark.createDataFrame([("A", "full", 3, 10, i) for i in range(50)], "song_id string, role string, a long, n long, id long")
    clips = render.layer_clips(df, waves(spark, {"A": np.arange(100.0)}), SIZE)
    assert clips.count() == 50 and clips.select("samples").distinct().count() == 1


@pytest.mark.parametrize("with_onsets", [False, True])
def test_render_equals_plain_loops(spark, with_onsets):
    r = random.Random(3)
    songs = {s: np.array([r.uniform(-1, 1) for _ in range(2500)]) for s in "ABC"}
    tiles, at = [], 0.0
    for i in range(14):
        tiles.append((at, r.choice([0.05, 0.2, 0.4, 0.9, 1.5]), r.choice("ABC"), r.uniform(0, 2.2)))
        at += r.choice([0.002, 0.05, 0.22, 0.3, 0.7])
    tiles[5] = (tiles[5][0], 0.3, tiles[4][2], tiles[4][3] + tiles[5][0] - tiles[4][0])  # goes on
    ends = [int(np.rint(tiles[i][0] * SR)) + d for i, d in ((2, 3), (6, -15), (9, 30))] if with_onsets else None
    rows = [("T", i, *t) for i, t in enumerate(tiles)] + [("U", 0, 0.0, 0.3, "A", 0.5)]
    layers = [("T", i, 0, t[2], "full", t[3], 1.0) for i, t in enumerate(tiles)] + [("U", 0, 0, "A", "full", 0.5, 0.7), ("U", 0, 1, "B", "full", 0.1, 0.3)]
    on = spark.createDataFrame([("T", o) for o in ends], "target string, at long") if with_onsets else None
    got = render.rendered(tiles_of(spark, rows), layers_of(spark, layers), waves(spark, songs), SR, 0.45, on, SIZE)

    def mix(i, length):
        a = int(np.rint(tiles[i][3] * SR))
        y = fit(songs[tiles[i][2]][a:], length)
        m = y.mean()
        return y - m if abs(m) < 0.2 * (np.abs(y).max() + 1e-9) else y

    want = plain_render(tiles, mix, SR, 0.45, ends)
    np.testing.assert_allclose(sound(got, len(want)), want, atol=1e-9)
    u = fit(songs["A"][500:], 300) + 0.405 * fit(songs["B"][100:], 300)
    u = u * min(1, 0.99 / np.abs(u).max())
    u -= u.mean()
    want = plain_render([(0.0, 0.3, "A", 0.5)], lambda i, n: u, SR, 0.3, None)
    np.testing.assert_allclose(sound(got, 300, "U")[16:280], want[16:280], atol=1e-9)


def test_level_seams_and_tails(spark):
    """Constant songs: level, no clicks or dropouts between unlike ones, a long note's tail, a further layer's level."""
    sr = 8000
    songs = {"A": np.full(3 * sr, 0.8), "B": np.full(3 * sr, 0.15), "C": np.full(sr, 0.4), "D": np.zeros(sr), "E": np.full(3 * sr, 0.5), "F": np.full(sr, 0.6), "G": np.full(sr, 0.2)}
    w = waves(spark, songs, 1024)
    one = lambda target, rows: [(target, i, s, d, song, src) for i, (s, d, song, src) in enumerate(rows)]
    rows = one("run", [(i * 0.5, 1.0, "E", i * 0.5) for i in range(4)]) + one("switch", [(i * 0.25, 0.5, "AB"[i % 2], 0.0) for i in range(8)]) + one("tail", [(0.0, 0.5, "C", 0.0), (0.2, 0.2, "D", 0.0)]) + one("two", [(0.0, 0.9, "F", 0.0)])
    layers = [(t, p, 0, song, "full", src, 0.7) for t, p, _, _, song, src in rows] + [("two", 0, 1, "G", "full", 0.0, 0.3)]
    out = render.rendered(tiles_of(spark, rows), layers_of(spark, layers), w, sr, 0.5, None, 1024)
    run = sound(out, int(2.0 * sr), "run")
    assert 0.35 < run[len(run) // 2] < 0.65
    y = sound(out, int(2.25 * sr), "switch")
    assert np.abs(y[sr // 2 : -sr // 2]).min() > 0.05 and np.abs(np.diff(y)).max() < 0.05
    assert np.abs(sound(out, int(0.7 * sr), "tail")[int(0.35 * sr) : int(0.42 * sr)]).mean() > 0.1
    assert sound(out, sr // 2, "two")[sr // 4] > 0.6


def test_render_of_nothing(spark):
    w = waves(spark, {"A": np.ones(200)})
    assert render.rendered(tiles_of(spark, []), layers_of(spark, []), w, SR, 0.45, None, SIZE).count() == 0


@pytest.mark.parametrize("weighted", [False, True])
def test_numbers_run_within_groups(spark, weighted):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]) if i % 3 else "a", i, r.randint(0, 9)) for i in range(700)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k long, w long").repartition(7)
    got = numbering.numbered(df, ["k"], ["g"], "at", F.col("w") if weighted else None).collect()
    want, sums = {}, {}
    for g, k, w in sorted(rows, key=lambda x: x[1]):
        want[k] = sums.get(g, 0)
        sums[g] = want[k] + (w if weighted else 1)
    assert {x["k"]: x["at"] for x in got} == want and len(got) == 700
    assert numbering.numbered(df.limit(0), ["k"]).count() == 0


def test_dense_index_of_repeated_keys(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 1), ("a", 1)], "s string, f long")
    keys, rows = numbering.dense_index(df, ["s", "f"])
    assert sorted(map(tuple, keys.collect())) == [("a", 1, 0), ("a", 2, 1), ("b", 1, 2)]
    assert sorted(x["index"] for x in rows.collect()) == [0, 1, 2, 2]


def plain_onsets(x, p):
    x = (x - x.min()) / (x.max() - x.min())
    out, minima = [], [i for i in range(1, len(x) - 1) if x[i] <= x[i - 1] and x[i] < x[i + 1]]
    for i in range(len(x)):
        near, wide = x[max(0, i - p.pre_max) : i + p.post_max], x[max(0, i - p.pre_avg) : i + p.post_avg]
        if x[i] == near.max() and x[i] >= wide.mean() + p.delta and (not out or i > out[-1][0] + p.wait):
            out.append((i, max([m for m in minima if m <= i], default=0)))
    return out


@pytest.mark.parametrize("size", [16, 100, 8192])
@pytest.mark.parametrize("wait", [0, 2, 9])
def test_onsets_cross_blocks(spark, size, wait):
    r = np.random.default_rng(5)
    p = onsets.PeakParams(wait=wait)
    curves = {"a": np.round(r.random(500) ** 3, 3), "b": np.repeat(np.round(r.random(40), 2), 5), "c": np.zeros(50), "d": np.array([0.3])}
    df = spark.createDataFrame([(s, i, float(v)) for s, x in curves.items() for i, v in enumerate(x)], "song_id string, f long, strength double").repartition(4)
    got = onsets.onsets(df, p, size).collect()
    for s, x in curves.items():
        want = plain_onsets(x, p) if x.max() > x.min() else []
        assert sorted((o["f"], o["start"]) for o in got if o["song_id"] == s) == want


def test_windows_reach_over_blocks_only_so_far(spark):
    with pytest.raises(ValueError):
        blocks.haloed(spark.range(3).withColumnRenamed("id", "f"), [], "f", 20, 0, 16)


def test_segment_descriptors_equal_plain_means(spark):
    r = np.random.default_rng(6)
    widths = {"chroma": 3, "register": 2, "mfcc": 2, "contrast": 1}
    frames, rows = {}, []
    for song, n in (("a", 300), ("b", 5), ("c", 1)):
        frames[song] = [{**{k: r.random(w) for k, w in widths.items()}, **{k: float(r.random()) for k in ("rms", "centroid", "flatness", "onset")}} for _ in range(n)]
        rows += [(song, f, *(x[k].tolist() for k in widths), x["rms"], x["centroid"], x["flatness"], x["onset"]) for f, x in enumerate(frames[song])]
    df = spark.createDataFrame(rows, "song_id string, f long, chroma array<double>, register array<double>, mfcc array<double>, contrast array<double>, rms double, centroid double, flatness double, onset double").repartition(3)
    segs = [(i, r.choice(["a", "b", "c"]).item(), float(a), float(a + r.choice([0.0, 0.01, 0.2, 3.0]))) for i, a in enumerate(r.uniform(0, 4, 60))]
    got = {x["segment"]: x for x in segments.described(df, spark.createDataFrame(segs, "segment long, song_id string, start_s double, end_s double"), 1000, 10, widths).collect()}
    assert len(got) == len(segs)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-8)
    for i, song, a, b in segs:
        own = frames[song]
        f0 = max(0, min(int(np.rint(a * 1000)) // 10, len(own) - 1))
        f1 = max(f0 + 1, min(int(np.rint(b * 1000)) // 10, len(own)))
        part = own[f0:f1]
        col = lambda k: np.array([x[k] for x in part])
        chunks = np.array_split(col("chroma"), 4)
        want = {
            "chroma": unit(col("chroma").mean(0)),
            "register": unit(col("register").mean(0)),
            "timbre": unit(np.concatenate([col("mfcc").mean(0), col("mfcc").std(0), col("contrast").mean(0)])),
            "temporal": unit(np.concatenate([c.mean(0) if len(c) else np.zeros(3) for c in chunks])),
            "energy": unit(np.array([col("rms").mean(), col("rms").std(), col("centroid").mean(), col("centroid").std(), col("flatness").mean(), col("onset").mean()])),
        }
        assert got[i]["n_frames"] == f1 - f0
        for k, v in want.items():
            np.testing.assert_allclose(got[i][k], v, atol=1e-9, err_msg=f"{i} {k}")
        assert abs(got[i]["level"] - min(max((20 * math.log10(col("rms").mean() + 1e-8) + 60) / 60, 0), 1)) < 1e-9


def test_a_tile_is_mixed_once_not_once_a_sample(spark):
    """Loud layers, so that the mix is limited and then centred; no filter of the plan may hold the mix, which Spark inlines into it."""
    n = 400
    x, y = np.random.default_rng(5).normal(0.1, 1.0, (2, n))
    clips = spark.createDataFrame([("T", 0, 0, 1.0, x.tolist()), ("T", 0, 1, 0.3, y.tolist())], "target string, place long, layer long, weight double, samples array<double>")
    mixes = render.tile_mixes(clips)
    want = x + 0.405 * y
    want = want * (0.99 / np.abs(want).max())
    want = want - want.mean()
    np.testing.assert_allclose(mixes.first()["samples"], want, atol=1e-12)
    plan = spark.createDataFrame([("T", 0, 0, n, 0, 0, False, n)], "target string, place long, pos long, length long, fade_in long, fade_out long, power boolean, n_out long")
    out = render.overlapped(plan.join(mixes, ["target", "place"]), 100)
    plans = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plans if "Filter" in line and "zip_with" in line]
    assert out.count() == n
    assert mixes._jdf.queryExecution().optimizedPlan().toString().count("zip_with") == 1  # the sum of two layers stands there once
