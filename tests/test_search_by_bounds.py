"""The search by bounds against all pairs and rotations, and steps that must not repeat it or grow with the square of a song."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest

from tessera.operators import decode, search
from tessera.plans import matching

from test_matching import SCHEMA

DATA = "/root/testdata/sf0.001"


def sides(n_targets, n_sources, copies=0, seed=3):
    """Targets and sources as rows; the last `copies` sources have the first one's descriptors."""
    rng = np.random.default_rng(seed)

    def rows(n, first, songs):
        out = []
        for i in range(n):
            v = [np.abs(rng.normal(size=12)), np.abs(rng.normal(size=48)), rng.normal(size=8), np.abs(rng.normal(size=4)), np.abs(rng.normal(size=3))]
            v = [(x / np.linalg.norm(x)).tolist() for x in v]
            out.append((first + i, songs[i % len(songs)], i // len(songs) + 1, 0.0, 1.0, *v, float(rng.random())))
        return out

    s = rows(n_sources, 0, "ABC")
    s[n_sources - copies :] = [(*r[:5], *s[0][5:]) for r in s[n_sources - copies :]]
    return rows(n_targets, 10_000, ["T5", "T6"]), s


def plain(targets, sources):
    """{(target, t): [(score, shift, source_id, song)]} of all pairs."""
    out = {}
    for q in targets:
        q_harmony = np.concatenate([0.68 * np.array(q[5]), 0.32 * np.array(q[6])])
        rows = []
        for s in sources:
            turns = [round(float(q_harmony @ np.concatenate([np.roll(s[5], k), *np.roll(np.reshape(s[6], (4, 12)), k, axis=1)])), 9) for k in range(12)]
            energy = 0.72 * np.dot(q[8], s[8]) + 0.28 * (1 - abs(q[10] - s[10]))
            score = 0.86 * (0.42 * max(turns) + 0.40 * np.dot(q[7], s[7]) + 0.18 * energy) + 0.14 * np.dot(q[9], s[9])
            rows.append((round(float(score), 6), turns.index(max(turns)), s[0], s[1]))
        out[q[1], q[2]] = sorted(rows, key=lambda r: (-r[0], r[2]))
    return out


def test_best_of_all_pairs_over_many_tasks_and_chunks(spark, monkeypatch):
    for name, n in {"MOST": 16, "FEWEST": 8, "TASKS": 4, "CHUNK": 20, "PART": 7, "BATCH": 5}.items():
        monkeypatch.setattr(search, name, n)
    t, s = sides(40, 150, copies=60)
    targets, sources = spark.createDataFrame(t, SCHEMA), spark.createDataFrame(s, SCHEMA)
    every = plain(t, s)
    got = {}
    for r in search.beam_topk(targets, sources, 6).collect():
        got.setdefault((r["target"], r["t"]), []).append((r["j"], r["score"], r["key_shift"], r["source_id"], r["song_id"]))
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == {k: v[:6] for k, v in every.items()}
    got = {}
    for r in search.scored(targets, sources, 2, True).collect():
        got.setdefault((r["target"], r["t"]), set()).add((r["score"], r["key_shift"], r["source_id"], r["song_id"]))
    for k, v in every.items():
        assert {x for song in "ABC" for x in [y for y in v if y[3] == song][:2]} <= got[k]


@pytest.mark.parametrize("copies", [0, 2500])
def test_rotations_are_tried_of_few_pairs(monkeypatch, copies):
    tried, whole = [], search.score_pairs
    monkeypatch.setattr(search, "score_pairs", lambda q, s, w, a, b, *more: tried.append(len(a)) or whole(q, s, w, a, b, *more))
    t, s = sides(100, 4000, copies)
    q, x = ({n: np.array([np.atleast_1d(r[i]) for r in rows]) for i, n in enumerate((*search.BLOCKS, "level"), 5)} for rows in (t, s))
    best = search._Best(q, 4, search.Weights())
    best.show(x, np.array([r[0] for r in s]), np.array([r[1] for r in s], object))
    assert sum(tried) < 100 * 4000 / 20


def test_blocks_that_a_row_lacks_drop_out_for_all(spark):
    t, s = sides(3, 9)
    s[4] = (*s[4][:6], None, *s[4][7:9], None, None)
    got = search.beam_topk(spark.createDataFrame(t, SCHEMA), spark.createDataFrame(s, SCHEMA), 1).collect()
    for r in got:
        q = next(x for x in t if (x[1], x[2]) == (r["target"], r["t"]))
        scores = [round(0.42 * max(round(float(np.dot(q[5], np.roll(x[5], k))), 9) for k in range(12)) + 0.40 * float(np.dot(q[7], x[7])) + 0.18 * float(np.dot(q[8], x[8])), 6) for x in s]
        assert abs(r["score"] - max(scores)) < 2e-6
    assert len(got) == 3


@pytest.mark.parametrize("made", [matching._beam, matching._knn, matching._candidates])
def test_what_queries_read_more_than_once_is_a_table(spark, monkeypatch, made):
    if made is matching._candidates:
        seen = []
        monkeypatch.setattr(matching.factorize, "candidate_beam", lambda scored, atoms, k: seen.append(scored) or scored)
        made(spark, DATA)
        rows = seen[0]
    else:
        rows = made(spark, DATA)[0]
    plan = rows._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Pandas" not in plan and rows.count() > 0


def test_quotas_and_runs_of_a_long_target(spark):
    rng, n = np.random.default_rng(5), 30_000
    songs = np.array(list("ABCDE"))
    tile = pd.DataFrame({"target": "T5", "t": np.arange(n) + 1, "j": 1, "source_id": rng.integers(0, 1000, n) * 5, "score": 0.9, "key_shift": 0})
    tile["source_id"] += np.where(rng.random(n) < 0.7, 0, rng.integers(0, 5, n))
    other = pd.concat([tile, *[tile.assign(j=j, source_id=rng.integers(0, 5000, n), score=0.9 - 0.1 * rng.random(n)) for j in (2, 3)]])
    for x in (tile, other):
        x["song_id"] = songs[x["source_id"] % 5]
    sources = spark.createDataFrame(pd.DataFrame({"source_id": np.arange(5000), "song_id": songs[np.arange(5000) % 5], "start_s": np.arange(5000) // 5 * 0.22}))
    rows, beam = spark.createDataFrame(tile), spark.createDataFrame(other)
    began = time.time()
    swapped = decode.enforce_max_share(rows, beam, sources, 0.4).toPandas()
    assert len(swapped) == n and swapped["song_id"].value_counts().max() == 0.4 * n
    absorbed = decode.enforce_min_runs(rows, sources, 3, 0.22, 1.0).toPandas()
    assert len(absorbed) == n and time.time() - began < 60


@pytest.mark.parametrize("seed", range(5))
def test_nearest_of_sorted_starts(seed):
    rng = np.random.default_rng(seed)
    starts, wanted = np.sort(rng.integers(0, 30, 40)) / 4, rng.integers(-8, 80, 60) / 8
    assert decode._nearest(starts, wanted).tolist() == np.abs(starts - wanted[:, None]).argmin(1).tolist()


def test_copies_of_one_song_are_dealt_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(search, "FEWEST", 8)
    targets, sources = sides(40, 60)
    t, s = (spark.createDataFrame(x, SCHEMA).coalesce(1) for x in (targets, sources))
    out = search.scored(t, s, 3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line for line in plan.splitlines() if "RepartitionByExpression [source_id" in line]
    assert [line.rsplit(", ", 1)[1] for line in dealt] == ["2", "5"]  # 5 blocks of targets, 2 of sources
    best = search.beam_topk(t, s, 3).toPandas().sort_values(["target", "t", "j"])
    want = plain(targets, sources)
    for (target, i), rows in best.groupby(["target", "t"]):
        assert rows["source_id"].tolist() == [r[2] for r in want[target, i][:3]]
