"""Rotation-aware search: every target row against every source row and twelve rotations, best k kept.

Rows meet in blocks: a task holds one block of targets and reads its sources as a stream. One matrix product bounds all pairs from
above, whatever the rotation; rotations are tried, in double precision, of the pairs alone whose bound reaches the target's k-th
best so far. So results are exact, no side is broadcast, and k rows for each target and task are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

BLOCKS = ("chroma", "temporal", "timbre", "energy", "register")
MOST, FEWEST, TASKS = 8192, 512, 48  # most targets of a task; fewest rows of a side for another task; so many tasks where rows suffice
CHUNK, PART, BATCH = 8192, 256, 2048  # sources taken from the stream, bounded at once; pairs whose rotations are tried at once
CHROMA, TEMPORAL = 0.68, 0.32
REGISTER = 0.14
ENERGY, LEVEL = 0.72, 0.28


@dataclass(frozen=True)
class Weights:
    chroma: float = 0.42
    timbre: float = 0.40
    energy: float = 0.18

    @staticmethod
    def of(backend: str) -> Weights:
        """Defaults by descriptor backend."""
        return Weights() if backend in ("mosaic", "handcrafted", "clap-hybrid") else Weights(0.48, 0.32, 0.20)


Side = dict[str, np.ndarray]  # a matrix for each descriptor block, a row for each descriptor


def _shares(x: Side) -> dict[str, float]:
    """The blocks that rotate, and their part of the harmony."""
    return {"chroma": CHROMA, "temporal": TEMPORAL} if "temporal" in x else {"chroma": 1.0}


def turned(x: Side) -> np.ndarray:
    """Fourier coefficients of the blocks that rotate, an octave at a time: all rotations' products come from one product of these."""
    width = x["chroma"].shape[1]
    return np.concatenate([np.fft.rfft(x[b].reshape(len(x[b]), -1, width), axis=2) for b in _shares(x)], axis=1)


def score_pairs(q: Side, s: Side, w: Weights, a: np.ndarray, b: np.ndarray, q_turned: np.ndarray, s_turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, shifts) of the pairs (q[a], s[b]): the best rotation by harmony (lowest of equals), then a weighted sum with timbre, dynamics and register."""
    width = q["chroma"].shape[1]

    def product(name: str) -> np.ndarray:
        return np.einsum("md,md->m", q[name][a], s[name][b])

    share = np.repeat(list(_shares(q).values()), [q[n].shape[1] // width for n in _shares(q)])
    both = q_turned[a] * s_turned[b].conj() * share[:, None]
    harmony = np.round(np.fft.irfft(both.sum(1), width, axis=1), 9)
    energy = product("energy")
    if "level" in q:
        energy = ENERGY * energy + LEVEL * np.clip(1 - np.abs(q["level"][a] - s["level"][b]).mean(1), 0, 1)
    score = w.chroma * harmony.max(1) + w.timbre * product("timbre") + w.energy * energy
    if "register" in q:
        score = (1 - REGISTER) * score + REGISTER * product("register")
    return np.round(score, 6), harmony.argmax(1).astype(np.int32)


def _features(x: Side, x_turned: np.ndarray, w: Weights | None) -> np.ndarray:
    """Rows whose products (weighted by the side with w) bound the scores of all rotations, but for the level's part.

    A rotation changes the phases of a block's Fourier coefficients, not their sizes: no rotation's product exceeds the product of the sizes.
    """
    width = x["chroma"].shape[1]
    rest = 1 - REGISTER if "register" in x else 1.0
    twice = np.full(width // 2 + 1, 2.0)
    twice[0] = 1.0
    if width % 2 == 0:
        twice[-1] = 1.0
    share = np.repeat(list(_shares(x).values()), [x[n].shape[1] // width for n in _shares(x)])
    sizes = np.abs(x_turned) * np.sqrt(twice / width) * (rest * abs(w.chroma) * share[:, None] if w else 1.0)
    out = [sizes.reshape(len(sizes), -1), x["timbre"] * (rest * w.timbre if w else 1.0), x["energy"] * (rest * w.energy * (ENERGY if "level" in x else 1.0) if w else 1.0)]
    if "register" in x:
        out.append(x["register"] * (REGISTER if w else 1.0))
    return np.concatenate(out, axis=1).astype(np.float32)


def _key(score: np.ndarray) -> np.ndarray:
    """What scores are sorted by, downwards: one that is no number counts as the largest, as where they are ranked."""
    return np.where(np.isnan(score), np.inf, score)


def _fewest_alike(s: Side, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the sources by id; of those that are alike in all only the k smallest ids, as no others can be among the k best."""
    order = np.argsort(ids, kind="stable")
    rows = np.ascontiguousarray(np.concatenate([x[order] for x in s.values()], axis=1)) + 0.0
    group = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_inverse=True)[1]
    by = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.append(True, group[by][1:] != group[by][:-1]))
    place = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    return order[np.sort(by[place < k])]


class _Best:
    """The k best sources of each row of q among those shown to it."""

    def __init__(self, q: Side, k: int, w: Weights) -> None:
        self.q, self.k, self.w = q, k, w
        self.turned = turned(q)
        self.bound = _features(q, self.turned, w)
        self.reach = np.linalg.norm(self.bound.astype(np.float64), axis=1)
        self.level = max(0.0, w.energy * LEVEL * (1 - REGISTER if "register" in q else 1.0)) if "level" in q else 0.0
        self.clear()

    def clear(self) -> None:
        self.least = np.full(len(self.bound), -np.inf)  # the k-th best so far
        self.rows: list[tuple[np.ndarray, ...]] = []  # (row of q, source_id, song, score, shift)
        self.new = 0  # rows since they were last cut to k

    def _scores(self, s: Side, s_turned: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [score_pairs(self.q, s, self.w, a[i : i + BATCH], b[i : i + BATCH], self.turned, s_turned) for i in range(0, len(a), BATCH)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _first(self, s: Side, s_turned: np.ndarray, bound: np.ndarray) -> None:
        """A first `least`: the k likeliest by bound of some sources."""
        some = np.linspace(0, len(bound) - 1, min(len(bound), 2048)).astype(np.int64)
        if len(some) <= self.k:
            return
        picks = [np.argpartition(-(self.bound[i : i + 512] @ bound[some].T), self.k - 1, axis=1)[:, : self.k] for i in range(0, len(self.bound), 512)]
        pick = np.concatenate(picks)
        found = self._scores(s, s_turned, np.repeat(np.arange(len(pick)), self.k), some[pick.ravel()])[0].reshape(pick.shape)
        self.least = np.where(np.isnan(found).any(1), -np.inf, found.min(1))

    def show(self, s: Side, ids: np.ndarray, songs: np.ndarray) -> None:
        own = _fewest_alike(s, ids, self.k)
        if "level" in s:
            own = own[np.argsort(s["level"][own].mean(1), kind="stable")]  # so that the levels of a part are near each other
        s, ids, songs = {n: x[own] for n, x in s.items()}, ids[own], songs[own]
        s_turned = turned(s)
        bound = _features(s, s_turned, None)
        if not self.rows:
            self._first(s, s_turned, bound)
        # what single precision and the rounding of scores can take
        spare = 1e-5 * self.reach * np.linalg.norm(bound.astype(np.float64), axis=1).max() + 1e-6
        for i in range(0, len(ids), PART):
            need = self.least - spare
            if self.level:
                level, mine = s["level"][i : i + PART].mean(1), self.q["level"].mean(1)
                away = np.maximum(0, np.maximum(level.min() - mine, mine - level.max()))
                need = need - self.level * np.clip(1 - away, 0, 1)
            part = bound[i : i + PART]
            a, b = np.divmod(np.flatnonzero(~(self.bound @ part.T < need.astype(np.float32)[:, None])), len(part))
            if len(a):
                score, shift = self._scores(s, s_turned, a, b + i)
                good = _key(score) >= self.least[a]
                a, b, score, shift = a[good], b[good] + i, score[good], shift[good]
                self.rows.append((a, ids[b], songs[b], score, shift))
                self.new += len(a)
            if self.new > self.k * len(self.bound):
                self._settle()
        self._settle()

    def _settle(self) -> None:
        if not self.rows:
            return
        a, ids, songs, score, shift = (np.concatenate(x) for x in zip(*self.rows))
        order = np.lexsort((ids, -_key(score), a))
        first = np.flatnonzero(np.append(True, a[order][1:] != a[order][:-1]))
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        last = order[place == self.k - 1]
        self.least[a[last]] = np.maximum(self.least[a[last]], _key(score[last]))
        keep = order[place < self.k]
        self.rows, self.new = [(a[keep], ids[keep], songs[keep], score[keep], shift[keep])], 0


BEAM = "target string, t long, source_id long, song_id string, score double, key_shift int"


def _matrix(x: pa.ChunkedArray) -> np.ndarray:
    x = x.combine_chunks()
    if not pa.types.is_list(x.type) and not pa.types.is_large_list(x.type):
        return x.to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)


def _blocks_of(targets: DataFrame, sources: DataFrame) -> tuple[int, int, list[str]]:
    """(targets, sources, descriptor blocks that all rows of both sides have in one width: others drop out)."""

    rows = [df.select(F.lit(x).alias("is_target"), "level", *[F.size(b).alias(b) for b in BLOCKS], *[F.col(b).isNotNull().cast("int").alias(f"{b}_is") for b in BLOCKS]) for df, x in ((targets, True), (sources, False))]
    sizes = [f(b).alias(f"{b}_{n}") for b in BLOCKS for n, f in (("low", F.min), ("high", F.max))]
    facts = rows[0].unionByName(rows[1]).groupBy("is_target").agg(F.count("*").alias("n"), F.count("level").alias("level"), *[F.sum(f"{b}_is").alias(b) for b in BLOCKS], *sizes)
    found = {r["is_target"]: r.asDict() for r in facts.collect()}
    if len(found) < 2:
        return 0, 0, []
    t, s = found[True], found[False]
    whole = [b for b in (*BLOCKS, "level") if t[b] == t["n"] and s[b] == s["n"]]
    whole = [b for b in whole if b == "level" or t[f"{b}_low"] == t[f"{b}_high"] == s[f"{b}_low"] == s[f"{b}_high"]]
    if "temporal" in whole and "chroma" in whole and t["temporal_low"] % t["chroma_low"]:
        whole.remove("temporal")
    return t["n"], s["n"], whole


def scored(targets: DataFrame, sources: DataFrame, k: int, per_song: bool = False, weights: Weights = Weights()) -> DataFrame:
    """Candidates (BEAM) among which are each target row's best k sources, or best k of each song: ties to the smaller source_id."""
    n_targets, n_sources, blocks = _blocks_of(targets, sources)
    if not n_targets or not n_sources:
        return targets.sparkSession.createDataFrame([], BEAM)
    if missing := {"chroma", "timbre", "energy"} - set(blocks):
        raise ValueError(f"rows lack {', '.join(sorted(missing))}, or differ in its width")
    n_t = max(-(-n_targets // MOST), min(TASKS, -(-n_targets // FEWEST)))
    n_s = min(-(-TASKS // n_t), -(-n_sources // (4 * FEWEST)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one task: its targets, then its sources (with per_song: song by song)."""
        held: list[pa.RecordBatch] = []
        best, names, song = None, None, None

        def found() -> Iterator[pa.RecordBatch]:
            if best is None or not best.rows:
                return
            a, ids, songs, score, shift = best.rows[0]
            columns = [names["song_id"].take(pa.array(a)), names["segment_idx"].take(pa.array(a)), pa.array(ids, pa.int64()), pa.array(songs, pa.string()), pa.array(score, pa.float64()), pa.array(shift, pa.int32())]
            for i in range(0, len(a), 65536):
                yield pa.record_batch([x.slice(i, 65536) for x in columns], names=[c.split()[0] for c in BEAM.split(", ")])

        def taken() -> Iterator[pa.RecordBatch]:
            nonlocal song
            rows = pa.Table.from_batches(held)
            held.clear()
            s = {b: _matrix(rows[b]) for b in blocks}
            ids, songs = rows["source_id"].to_numpy(), np.array(rows["song_id"].to_pylist(), object)
            new = np.flatnonzero(np.append(True, songs[1:] != songs[:-1])) if per_song else np.zeros(1, np.int64)
            for i, j in zip(new, np.append(new[1:], len(ids))):
                if per_song and songs[i] != song:
                    yield from found()
                    best.clear()
                    song = songs[i]
                best.show({n: x[i:j] for n, x in s.items()}, ids[i:j], songs[i:j])

        goals: list[pa.RecordBatch] = []
        for batch in batches:
            mine = np.asarray(batch.column("is_target").to_numpy(zero_copy_only=False), bool)
            n = int(mine.sum())  # targets come first
            if n:
                goals.append(batch.slice(0, n))
            if n == batch.num_rows:
                continue
            if best is None:
                if not goals:
                    return
                rows = pa.Table.from_batches(goals)
                names = {c: rows[c].combine_chunks() for c in ("song_id", "segment_idx")}
                best = _Best({b: _matrix(rows[b]) for b in blocks}, k, weights)
            held.append(batch.slice(n))
            if sum(x.num_rows for x in held) >= CHUNK:
                yield from taken()
        if held:
            yield from taken()
        yield from found()

    def dealt(df: DataFrame, is_target: bool) -> DataFrame:
        own, other = (n_t, n_s) if is_target else (n_s, n_t)
        mine = F.pmod(F.xxhash64("source_id"), F.lit(own))
        theirs = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long")))
        if other > 1:  # rows arrive song by song: copies are made in as many tasks as get them, not in as many as there are songs
            df = df.select("source_id", "song_id", "segment_idx", *blocks).repartition(other, "source_id")
        rows = df.select("source_id", "song_id", "segment_idx", *blocks, F.lit(is_target).alias("is_target"), mine.alias("mine"), theirs.alias("theirs"))
        task = F.col("mine") * n_s + F.col("theirs") if is_target else F.col("theirs") * n_s + F.col("mine")
        return rows.withColumn("task", task.cast("int")).drop("mine", "theirs")

    rows = dealt(targets, True).unionByName(dealt(sources, False)).repartitionById(n_t * n_s, "task")
    rows = rows.sortWithinPartitions(F.desc("is_target"), *(["song_id"] if per_song else [])).drop("task")
    return rows.mapInArrow(search, BEAM)


def _ranked(rows: DataFrame, by: list[str], *order: F.Column) -> DataFrame:
    return rows.withColumn("j", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def beam_topk(targets: DataFrame, sources: DataFrame, k: int = 20, weights: Weights = Weights()) -> DataFrame:
    """The k best sources of each target row: j from 1, score down, ties to the smaller source_id."""
    return _ranked(scored(targets, sources, k, False, weights), ["target", "t"], F.desc("score"), F.col("source_id")).where(F.col("j") <= k)


def beam_diverse(targets: DataFrame, sources: DataFrame, k: int = 20, per_song: int = 4, weights: Weights = Weights()) -> DataFrame:
    """The best per_song of every song, filled up from all others to k, then cut to k: score down, ties to the larger source_id.

    Where songs * per_song exceeds k, a song of low scores can be cut.
    """
    per_song = max(1, per_song)
    own = _ranked(scored(targets, sources, per_song, True, weights), ["target", "t", "song_id"], F.desc("score"), F.col("source_id")).where(F.col("j") <= per_song).drop("j")
    own = written(own, "own")  # read three times
    have = own.groupBy("target", "t").agg(F.count("*").alias("n"))
    # the rest: as many of the best overall as are missing; k of the unused are enough, so k plus the picks of all songs hold them
    every = scored(targets, sources, k + per_song * 8, False, weights)
    unused = every.join(own.select("target", "t", "source_id"), ["target", "t", "source_id"], "left_anti")
    fill = _ranked(unused, ["target", "t"], F.desc("score"), F.col("source_id")).join(have, ["target", "t"]).where(F.col("j") <= k - F.col("n"))
    rows = own.unionByName(fill.select(*own.columns))
    return _ranked(rows, ["target", "t"], F.desc("score"), F.desc("source_id")).where(F.col("j") <= k)
