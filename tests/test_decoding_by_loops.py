"""Decoding, quotas, runs, the whole matcher and learnt activations on the smallest tables, against plain loops over collected rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.costs import MatchParams
from tessera.functions.vectors import shares
from tessera.operators import decode, factorize, mosaic, search
from tessera.sources import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def sides(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id < 300").cache()
    t, s = catalog.targets(e).cache(), catalog.sources(e).cache()
    return t, s


@pytest.fixture(scope="module")
def plain(sides):
    t, s = ({(r["song_id"], r["segment_idx"]): r.asDict() for r in x.collect()} for x in sides)
    return t, {r["source_id"]: r for r in s.values()}


def rows_of(beam):
    out = {}
    for r in beam.orderBy("target", "t", "j").collect():
        out.setdefault(r["target"], {}).setdefault(r["t"], []).append(r)
    return out


def dot(a, b):
    return float(sum(x * y for x, y in zip(a, b)))


def path_by_loops(beam, targets, sources, p):
    """{target: [(t, row of the beam)]} after all passes of share balancing."""
    songs = {s["song_id"] for s in sources.values()}
    limit = min(p.max_share, 1 / len(songs)) if p.max_share > 0 else 1 / len(songs)
    out = {}
    for target, steps in beam.items():
        bias = Counter()
        for n in range(max(1, p.balance_iters if p.lambda_balance > 0 else 1)):
            times = sorted(steps)
            cost, back = [], []
            for k, t in enumerate(times):
                now, came = [], []
                for y in steps[t]:
                    b, goal = sources[y["source_id"]], targets[target, t]
                    own = 1 - y["score"] + p.lambda_duration * min(1.5, abs(math.log(max(0.02, b["end_s"] - b["start_s"]) / max(0.02, goal["end_s"] - goal["start_s"])))) + bias[y["song_id"]]
                    if k == 0:
                        now.append(round(own, 9))
                        continue
                    step = goal["start_s"] - targets[target, times[k - 1]]["start_s"]
                    best = None
                    for i, x in enumerate(steps[times[k - 1]]):
                        a = sources[x["source_id"]]
                        concat = p.lambda_concat * (1 - (0.4 * dot(a["chroma"], b["chroma"]) + 0.4 * dot(a["timbre"], b["timbre"]) + 0.2 * dot(a["energy"], b["energy"])))
                        off = abs(a["start_s"] + step - b["start_s"])
                        if a["song_id"] == b["song_id"] and off < max(0.06, 0.55 * step):
                            c = -0.28 + 0.1 * concat
                        else:
                            c = concat + (p.lambda_jump * min(1, off / p.jump_norm_s) if a["song_id"] == b["song_id"] else p.lambda_switch) + (p.lambda_self if x["source_id"] == y["source_id"] else 0)
                        c += 0.06 * min(6, abs(x["key_shift"] - y["key_shift"]))
                        through = round(cost[-1][i] + c, 9)
                        if best is None or through < best[0]:
                            best = (through, i)
                    now.append(round(best[0] + own, 9))
                    came.append(best[1])
                cost.append(now)
                back.append(came)
            at = int(np.argmin(cost[-1]))
            places = [at]
            for k in range(len(times) - 1, 0, -1):
                at = back[k][at]
                places.append(at)
            path = [(t, steps[t][j]) for t, j in zip(times, places[::-1])]
            share = Counter(r["song_id"] for _, r in path)
            bias = Counter({s: p.lambda_balance * max(0.0, c / len(path) - limit) ** 1.25 * (1 + 0.55 * n) for s, c in share.items()})
        out[target] = path
    return out


def swaps_by_loops(tiles, beam, sources, max_share):
    """tiles: [[t, source_id, song_id, start_s, score, key_shift]], changed in place."""
    songs = {s["song_id"] for s in sources.values()}
    limit = max(1, math.floor(max_share * len(tiles)))
    for _ in range(len(tiles)):
        n = Counter(x[2] for x in tiles)
        best = None
        for x in tiles:
            for c in beam[x[0]]:
                if n[x[2]] > limit and c["song_id"] in songs and n[c["song_id"]] < limit and c["source_id"] != x[1] and (best is None or x[4] - c["score"] < best[0]):
                    best = (x[4] - c["score"], x, c)
        if best is None:
            return
        _, x, c = best
        x[1:] = [c["source_id"], c["song_id"], sources[c["source_id"]]["start_s"], c["score"], c["key_shift"]]


def runs_by_loops(tiles, sources, min_run, hop, max_share):
    limit = max(1, math.floor(max_share * len(tiles))) if max_share > 0 else len(tiles)
    song = [x[2] for x in tiles]
    used = set(song)
    if len(tiles) < min_run:
        return
    runs, first = [], 0
    for i in range(1, len(song) + 1):
        if i == len(song) or song[i] != song[first]:
            runs.append((first, i))
            first = i
    for r, (a, b) in enumerate(runs):
        if b - a >= min_run or len(runs) == 1:
            continue
        left = runs[r - 1][1] - runs[r - 1][0] if r else -1
        right = runs[r + 1][1] - runs[r + 1][0] if r + 1 < len(runs) else -1
        taker = song[runs[r - 1][0]] if left >= right else song[b]
        if sum(x[2] == taker for x in tiles) + b - a > limit or taker not in used:
            continue
        clips = sorted((s["start_s"], i) for i, s in sources.items() if s["song_id"] == taker)
        before = r > 0 and song[a - 1] == taker
        beside = a - 1 if before else b
        place, shift = tiles[beside][3], tiles[beside][5]
        for k in range(a, b):
            want = place + hop * (k - a + 1) if before else place + hop * (k - b)
            start, source = min(clips, key=lambda c: abs(c[0] - want))
            tiles[k][1:] = [source, taker, start, tiles[k][4] * 0.98, shift]


def as_tiles(path, sources):
    return [[t, r["source_id"], r["song_id"], sources[r["source_id"]]["start_s"], r["score"], r["key_shift"]] for t, r in path]


def close(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    np.testing.assert_allclose([g[3:5] for g in got], [w[3:5] for w in want], atol=1e-9)
    assert [g[5] for g in got] == [w[5] for w in want]


def collected(tiles):
    out = {}
    for r in tiles.orderBy("target", "t").collect():
        out.setdefault(r["target"], []).append([r["t"], r["source_id"], r["song_id"], r["start_s"], r["score"], r["key_shift"]])
    return out


@pytest.mark.parametrize("p", [MatchParams(top_k=4, lambda_balance=0.8, balance_iters=3), MatchParams(top_k=3), MatchParams(top_k=4, lambda_balance=2.0, balance_iters=2, max_share=0.1, lambda_switch=0.5)])
def test_balanced_paths(sides, plain, p):
    beam = search.beam_topk(*sides, p.top_k).cache()
    want = path_by_loops(rows_of(beam), *plain, p)
    got = {}
    for r in decode.balanced_path(beam, *sides, p).orderBy("target", "t").collect():
        got.setdefault(r["target"], []).append((r["t"], r["j"]))
    assert got == {t: [(k, r["j"]) for k, r in path] for t, path in want.items()}


@pytest.mark.parametrize("max_share", [0.25, 0.4, 0.05])
def test_swaps_to_the_quota(sides, plain, max_share):
    beam = search.beam_topk(*sides, 5).cache()
    sources, by = plain[1], rows_of(beam)
    first = {t: [(k, rows[0]) for k, rows in sorted(steps.items())] for t, steps in by.items()}
    got = collected(decode.enforce_max_share(beam.where("j = 1"), beam, sides[1], max_share))
    for t, path in first.items():
        tiles = as_tiles(path, sources)
        swaps_by_loops(tiles, by[t], sources, max_share)
        close(got[t], tiles)


@pytest.mark.parametrize("min_run,max_share", [(2, 1.0), (3, 0.5), (4, 0.0), (2, 0.2)])
def test_absorbed_runs(sides, plain, min_run, max_share):
    beam = search.beam_topk(*sides, 1).cache()
    got = collected(decode.enforce_min_runs(beam, sides[1], min_run, 0.22, max_share))
    for t, steps in rows_of(beam).items():
        tiles = as_tiles([(k, rows[0]) for k, rows in sorted(steps.items())], plain[1])
        runs_by_loops(tiles, plain[1], min_run, 0.22, max_share)
        close(got[t], tiles)


@pytest.mark.parametrize("p", [MatchParams(top_k=4, max_share=0.5, min_run=2, n_layers=2, lambda_balance=0.5), MatchParams(top_k=8, max_share=0.3, min_run=3, n_layers=2, fidelity_first=False, per_song_k=2, lambda_balance=0.25)])
def test_the_whole_matcher(sides, plain, p):
    beam = (search.beam_topk(*sides, p.top_k) if p.fidelity_first else search.beam_diverse(*sides, p.top_k, p.per_song_k)).cache()
    by, (targets, sources) = rows_of(beam), plain
    found = mosaic.match_sequence(*sides, p)
    got, figures = collected(found.tiles), {r["target"]: r for r in found.summary.collect()}
    for t, path in path_by_loops(by, targets, sources, p).items():
        tiles = as_tiles(path, sources)
        for step in ("share", "runs", "share") if not p.fidelity_first else ("runs",):
            if step == "share":
                swaps_by_loops(tiles, by[t], sources, p.max_share)
            else:
                runs_by_loops(tiles, sources, p.min_run, p.hop_s, p.max_share)
        close(got[t], tiles)
        song = [x[2] for x in tiles]
        greedy = [rows[0]["song_id"] for _, rows in sorted(by[t].items())]
        changes = lambda x: sum(a != b for a, b in zip(x, x[1:]))
        f = figures[t]
        assert (f["tiles"], f["transitions"], f["greedy_transitions"]) == (len(tiles), changes(song), changes(greedy))
        assert abs(f["similarity"] - np.mean([x[4] for x in tiles])) < 1e-9
    weights = {}
    for r in found.layers.collect():
        weights.setdefault((r["target"], r["t"]), []).append((r["song_id"], r["weight"]))
    for own in weights.values():
        assert abs(sum(w for _, w in own) - 1) < 1e-9 and len({s for s, _ in own}) == len(own) <= p.n_layers


def test_learnt_activations(sides):
    """Dense updates over every row and slot."""
    t, s = sides
    p = factorize.FactorParams(iterations=6, polyphony=2)
    beam = search.beam_topk(t, s, 6)
    atoms = s.select("source_id", F.col("segment_idx").alias("frame"), shares(F.col("chroma")).alias("shape"))
    goal = t.select(F.col("song_id").alias("target"), F.col("segment_idx").alias("t"), shares(F.col("chroma")).alias("goal"))
    rows = beam.join(atoms, "source_id").join(goal, ["target", "t"]).select("target", "t", F.col("j").alias("slot"), "source_id", "song_id", "frame", "shape", "goal").cache()
    got = {(r["target"], r["t"], r["slot"]): r for r in factorize.learn(rows, p).collect()}
    groups = {}
    for r in rows.orderBy("target", "t", "slot").collect():
        groups.setdefault(r["target"], {}).setdefault(r["t"], []).append(r)
    for target, steps in groups.items():
        times = sorted(steps)
        h = [[1 / len(steps[t])] * len(steps[t]) for t in times]
        goals = [np.array(steps[t][0]["goal"]) for t in times]
        shapes = [[np.array(r["shape"]) for r in steps[t]] for t in times]
        for it in range(p.iterations):
            done = (it + 1) / p.iterations
            for n in range(len(times)):
                estimate = sum(x * w for x, w in zip(h[n], shapes[n])) + 1e-8
                h[n] = [x * float((w * goals[n] / estimate).sum()) / (float(w.sum()) + 1e-8) for x, w in zip(h[n], shapes[n])]
            for lag in (1, 2, 3):
                old = [list(x) for x in h]
                for n in range(lag, len(times)):
                    if np.abs(goals[n] - goals[n - lag]).sum() > 0.08:
                        for k, r in enumerate(steps[times[n]]):
                            same = [old[n - lag][i] for i, q in enumerate(steps[times[n - lag]]) if q["source_id"] == r["source_id"]]
                            if same and max(same) >= old[n][k]:
                                h[n][k] *= 1 - done * (1 - p.repetition_suppression)
            old = [list(x) for x in h]
            for n in range(1, len(times)):
                for k, r in enumerate(steps[times[n]]):
                    on = [old[n - 1][i] for i, q in enumerate(steps[times[n - 1]]) if q["song_id"] == r["song_id"] and q["frame"] + 1 == r["frame"]]
                    h[n][k] += p.continuity * done * max(on, default=0.0)
            for n in range(len(times)):
                if done >= 0.5:
                    best = {}
                    for k, r in enumerate(steps[times[n]]):
                        if r["song_id"] not in best or h[n][k] > h[n][best[r["song_id"]]]:
                            best[r["song_id"]] = k
                    top = sorted(best.values(), key=lambda k: (-h[n][k], k))[: p.polyphony]
                    h[n] = [x if k in top else 0.0 for k, x in enumerate(h[n])]
                total = max(sum(h[n]), 1e-8)
                h[n] = [x / total for x in h[n]]
        for n, t in enumerate(times):
            for k, r in enumerate(steps[t]):
                assert abs(got[target, t, r["slot"]]["h"] - h[n][k]) < 1e-7
        error = np.mean([np.abs(goals[n] - sum(x * w for x, w in zip(h[n], shapes[n]))).mean() for n in range(len(times))])
        assert abs(got[target, times[0], steps[times[0]][0]["slot"]]["error"] - error) < 1e-7
