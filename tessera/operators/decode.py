"""From beams to tiles: pairs, step costs, the cheapest path, shares, quotas, runs, layers."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.costs import MatchParams, complementarity, discontinuity, duration_cost, join_distance, key_jump, residual_fill, role, transition_cost
from ..functions.vectors import dot
from ..sources.shared import written

DESCRIPTOR = ("song_id", "start_s", "end_s", "chroma", "timbre", "energy")


def _fresh(df: DataFrame) -> DataFrame:
    """df with columns of its own, for a cogroup of two frames from one source."""
    return df.toDF(*df.columns)


def adjacent_pairs(beam: DataFrame) -> DataFrame:
    """Distinct (target, a, b): sources that can follow each other in a target."""
    x = beam.select("target", F.col("t").alias("tx"), F.col("source_id").alias("a"))
    y = beam.select("target", (F.col("t") - 1).alias("tx"), F.col("source_id").alias("b"))
    return x.join(y, ["target", "tx"]).select("target", "a", "b").distinct()


def concat_costs(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with both rows' descriptors as structs a_ and b_, and their discontinuity."""
    row = sources.select("source_id", F.struct(*DESCRIPTOR).alias("row"))
    out = pairs.join(row.toDF("a", "a_"), "a").join(row.toDF("b", "b_"), "b")
    return out.withColumn("concat", discontinuity("a_", "b_"))


def local_costs(beam: DataFrame, targets: DataFrame, sources: DataFrame, p: MatchParams = MatchParams(), bias: DataFrame | None = None) -> DataFrame:
    """beam with local cost 1 - score + duration cost (+ bias of (target, song_id)), and the row's start."""
    t = targets.select(F.col("song_id").alias("target"), F.col("segment_idx").alias("t"), F.col("start_s").alias("target_start"), (F.col("end_s") - F.col("start_s")).alias("target_s"))
    s = sources.select("source_id", (F.col("end_s") - F.col("start_s")).alias("source_s"))
    out = beam.join(t, ["target", "t"]).join(s, "source_id")
    cost = 1 - F.col("score") + duration_cost(F.col("source_s"), F.col("target_s"), p.lambda_duration)
    if bias is not None:
        out = out.join(bias, ["target", "song_id"], "left")
        cost = cost + F.coalesce("bias", F.lit(0.0))
    return out.withColumn("local", cost)


def step_costs(beam: DataFrame, targets: DataFrame, sources: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
    """(target, t, i, j, a, b, cost): going from beam place i of the row before to place j of row t."""
    pairs = concat_costs(adjacent_pairs(beam).select("a", "b").distinct(), sources).select("a", "b", F.col("a_.song_id").alias("a_song"), F.col("b_.song_id").alias("b_song"), F.col("a_.start_s").alias("a_start"), F.col("b_.start_s").alias("b_start"), "concat")
    starts = targets.select(F.col("song_id").alias("target"), F.col("segment_idx").alias("t"), "start_s")
    w = Window.partitionBy("target").orderBy("t")
    steps = starts.withColumn("step", F.col("start_s") - F.lag("start_s").over(w)).drop("start_s")
    x = beam.select("target", (F.col("t") + 1).alias("t"), F.col("j").alias("i"), F.col("source_id").alias("a"), F.col("key_shift").alias("a_shift"))
    y = beam.select("target", "t", "j", F.col("source_id").alias("b"), F.col("key_shift").alias("b_shift"))
    rows = x.join(y, ["target", "t"]).join(steps, ["target", "t"]).join(pairs, ["a", "b"])
    join = F.lit(0.0)  # without edge fingerprints
    if {"head", "tail"} <= set(sources.columns):
        rows = rows.join(sources.select(F.col("source_id").alias("a"), "tail"), "a").join(sources.select(F.col("source_id").alias("b"), "head"), "b")
        join = join_distance(F.col("a"), F.col("b"), "tail", "head")
    cost = transition_cost(F.col("a_song") == F.col("b_song"), F.col("a") == F.col("b"), F.col("a_start"), F.col("b_start"), F.col("step"), p.lambda_concat * F.col("concat"), p.lambda_join * join, p)
    return rows.select("target", "t", "i", "j", "a", "b", (cost + key_jump(F.col("a_shift"), F.col("b_shift"))).alias("cost"))


PATH = "target string, t long, j long, cost double"


def cheapest_path(local: DataFrame, steps: DataFrame) -> DataFrame:
    """(target, t, j, cost): each target's path of least cost, and the cost so far (ties to lower places, at 9 digits).

    local: (target, t, j, local); steps: (target, t, i, j, cost). One target's beam is a group; targets are songs of bounded length.
    """

    def decode(local: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        if local.empty:
            return pd.DataFrame({"target": [], "t": [], "j": [], "cost": []})
        times = np.sort(local["t"].unique())
        k = int(local["j"].max())
        place = {t: n for n, t in enumerate(times.tolist())}
        own = np.full((len(times), k), np.inf)
        own[local["t"].map(place), local["j"] - 1] = local["local"]
        step = np.full((len(times), k, k), np.inf)
        if len(steps):
            steps = steps[steps["t"].isin(place)]
            step[steps["t"].map(place), steps["i"] - 1, steps["j"] - 1] = steps["cost"]
        best, back = own[0].round(9), np.zeros((len(times), k), np.int64)
        so_far = [best]
        for n in range(1, len(times)):
            through = (best[:, None] + step[n]).round(9)
            back[n] = through.argmin(0)
            best = (through.min(0) + own[n]).round(9)
            so_far.append(best)
        at = int(best.argmin())
        path = [at]
        for n in range(len(times) - 1, 0, -1):
            at = int(back[n, at])
            path.append(at)
        path = path[::-1]
        return pd.DataFrame({"target": local["target"].iloc[0], "t": times, "j": np.array(path) + 1, "cost": [so_far[n][j] for n, j in enumerate(path)]})

    return _fresh(local).groupBy("target").cogroup(_fresh(steps).groupBy("target")).applyInPandas(decode, PATH)


def clip_ids(sources: DataFrame) -> DataFrame:
    """Each song's source_ids by start."""
    rows = sources.groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("start_s", "source_id"))).alias("r"))
    return rows.select("song_id", F.transform("r", lambda x: x["source_id"]).alias("ids"))


def missing_songs(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Songs of the sources that a target does not use."""
    songs = sources.agg(F.collect_set("song_id")).scalar()
    return rows.groupBy("target").agg(F.collect_set("song_id").alias("used")).select("target", F.explode(F.array_except(songs, "used")).alias("song_id"))


def tiles(path: DataFrame, beam: DataFrame) -> DataFrame:
    """The beam's rows on the path, with all candidates of the row as an array."""
    row = beam.groupBy("target", "t").agg(F.sort_array(F.collect_list(F.struct("j", "source_id", "key_shift", "score"))).alias("candidates"))
    return path.select("target", "t", "j").join(beam, ["target", "t", "j"]).join(row, ["target", "t"])


def song_shares(rows: DataFrame, by: str = "target") -> DataFrame:
    """Share of each song among a target's rows."""
    n = rows.groupBy(by, "song_id").agg(F.count("*").cast("long").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def transitions(rows: DataFrame) -> DataFrame:
    """Song changes from row to row of each target."""
    w = Window.partitionBy("target").orderBy("t")
    changed = F.col("song_id") != F.lag("song_id").over(w)
    return rows.withColumn("c", changed).groupBy("target").agg(F.sum(F.coalesce(F.col("c").cast("long"), F.lit(0))).alias("transitions"))


def balanced_path(beam: DataFrame, targets: DataFrame, sources: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
    """The cheapest path, decoded p.balance_iters times if balance counts, each time with a cost on songs above their share: replaced, not added, at every pass."""
    steps = written(step_costs(beam, targets, sources, p), "steps")  # every pass reads them
    songs = max(1, sources.select("song_id").distinct().count())
    limit = min(p.max_share, 1.0 / songs) if p.max_share > 0 else 1.0 / songs
    bias, path = None, None
    for n in range(max(1, p.balance_iters if p.lambda_balance > 0 else 1)):
        path = cheapest_path(local_costs(beam, targets, sources, p, bias).select("target", "t", "j", "local"), steps)
        over = F.greatest(F.lit(0.0), F.col("share") - limit)
        bias = song_shares(path.join(beam, ["target", "t", "j"])).select("target", "song_id", (p.lambda_balance * F.pow(over, 1.25) * (1 + 0.55 * n)).alias("bias"))
    return path


def runs(rows: DataFrame) -> DataFrame:
    """Maximal stretches of one song: target, run, song_id, first, last, length."""
    w = Window.partitionBy("target").orderBy("t")
    new = F.coalesce((F.col("song_id") != F.lag("song_id").over(w)).cast("long"), F.lit(1))
    numbered = rows.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return numbered.groupBy("target", "run").agg(F.min("song_id").alias("song_id"), F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").cast("long").alias("length"))


def absorbing_songs(run_rows: DataFrame, min_run: int) -> DataFrame:
    """Runs shorter than min_run with the song that takes them: the longer neighbour's, the left one's if equal."""
    w = Window.partitionBy("target").orderBy("run")
    rows = run_rows.withColumns({n: F.lag(F.struct("length", "song_id"), k).over(w) for n, k in (("left", 1), ("right", -1))})
    right = F.col("right").isNotNull() & (F.col("left").isNull() | (F.col("right.length") > F.col("left.length")))
    return rows.where(F.col("length") < min_run).select("target", "run", "song_id", "length", F.when(right, F.col("right.song_id")).otherwise(F.col("left.song_id")).alias("taken_by"))


def nearest_clip(wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """wanted (song_id, want, ...) with the source of that song that starts nearest: ties to the earlier start, then the smaller id.

    Both neighbours come from one sort of the song's clips and wishes; no pair of the two is made but these.
    """
    keys = [c for c in wanted.columns]
    s = sources.select("song_id", F.col("start_s").alias("at"), F.struct("start_s", "source_id").alias("clip"), F.lit(None).cast(wanted.select(F.struct(*keys)).schema[0].dataType).alias("wish"))
    firsts = s.withColumn("r", F.row_number().over(Window.partitionBy("song_id", "at").orderBy("clip.source_id"))).where("r = 1").drop("r")
    w = wanted.select("song_id", F.col("want").alias("at"), F.lit(None).cast(firsts.schema["clip"].dataType).alias("clip"), F.struct(*keys).alias("wish"))
    order = Window.partitionBy("song_id").orderBy("at", F.col("wish").isNotNull())
    rows = firsts.unionByName(w)
    rows = rows.withColumns({"before": F.last("clip", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "after": F.first("clip", True).over(order.rowsBetween(0, Window.unboundedFollowing))})
    d_before, d_after = F.round(F.col("at") - F.col("before.start_s"), 9), F.round(F.col("after.start_s") - F.col("at"), 9)
    pick = F.when(F.col("before").isNull(), F.col("after")).when(F.col("after").isNull() | (d_before <= d_after), F.col("before")).otherwise(F.col("after"))
    return rows.where("wish is not null").select("wish.*", pick["source_id"].alias("source_id"), pick["start_s"].alias("start_s"))


def layer_candidates(rows: DataFrame, beam: DataFrame, targets: DataFrame, sources: DataFrame, p: MatchParams) -> DataFrame:
    """For each tile, its eligible further songs, best clip each: (target, t, source_id, song_id, score, comp, rank)."""
    s = sources.withColumn("role", role("register", "energy")).select("source_id", "chroma", "timbre", "role")
    main = rows.select("target", "t", F.col("source_id").alias("main_id"), F.col("song_id").alias("main_song"), F.col("score").alias("main_score"))
    main = main.join(s.toDF("main_id", "main_chroma", "main_timbre", "main_role"), "main_id")
    goal = targets.select(F.col("song_id").alias("target"), F.col("segment_idx").alias("t"), F.col("chroma").alias("goal"))
    least = 0.82 if p.fidelity_first else 0.55
    c = beam.join(main, ["target", "t"]).where((F.col("song_id") != F.col("main_song")) & (F.col("score") >= F.greatest(F.lit(0.22), F.col("main_score") * least)))
    c = c.join(s, "source_id").join(goal, ["target", "t"])
    comp = complementarity(F.col("score"), dot("main_timbre", "timbre"), residual_fill("goal", "main_chroma", "chroma"), F.col("main_role"), F.col("role"))
    c = c.withColumn("comp", F.round(comp, 6))
    best = F.row_number().over(Window.partitionBy("target", "t", "song_id").orderBy(F.desc("comp"), F.desc("source_id")))
    c = c.withColumn("own", best).where("own = 1")
    rank = F.row_number().over(Window.partitionBy("target", "t").orderBy(F.desc("comp"), F.desc("source_id")))
    return c.withColumn("rank", rank).select("target", "t", "source_id", "song_id", "score", "comp", F.col("rank").cast("long").alias("rank"))


def layers(rows: DataFrame, beam: DataFrame, targets: DataFrame, sources: DataFrame, p: MatchParams) -> DataFrame:
    """(target, t, layer, source_id, song_id, weight): the tile itself, then up to n_layers - 1 other songs; weights sum to 1."""
    more = layer_candidates(rows, beam, targets, sources, p).where(F.col("rank") < max(1, p.n_layers))
    own = Window.partitionBy("target", "t")
    raw = F.greatest(F.lit(1e-3), F.col("score"))
    more = more.withColumn("e", F.exp((raw - F.max(raw).over(own)) / 0.28))
    primary = min(max(p.layer_primary_weight, 0.45), 0.85)
    more = more.withColumn("weight", (1 - primary) * F.col("e") / F.sum("e").over(own))
    have = more.select("target", "t").distinct().withColumn("some", F.lit(True))
    first = rows.join(have, ["target", "t"], "left").select("target", "t", F.lit(0).cast("long").alias("layer"), "source_id", "song_id", F.when(F.col("some"), F.lit(primary)).otherwise(F.lit(1.0)).alias("weight"))
    return first.unionByName(more.select("target", "t", F.col("rank").alias("layer"), "source_id", "song_id", "weight"))


def contributions(layer_rows: DataFrame, songs: tuple[str, ...]) -> DataFrame:
    """Each song's part of all weight in percent, of every listed song, to one place."""
    targets = layer_rows.select("target").distinct()
    sums = layer_rows.groupBy("target", "song_id").agg(F.sum("weight").alias("w"))
    whole = sums.groupBy("target").agg(F.sum("w").alias("total"))
    # a row for each target and listed song: the list is the fixed handful of sources
    grid = targets.select("target", F.explode(F.array(*[F.lit(s) for s in songs])).alias("song_id"))
    out = grid.join(sums, ["target", "song_id"], "left").join(whole, "target")
    return out.select("target", "song_id", F.round(F.coalesce(F.col("w") / F.when(F.col("total") > 0, F.col("total")), F.lit(0.0)) * 100, 1).alias("pct"))


TILES = "target string, t long, source_id long, song_id string, start_s double, score double, key_shift int"


def enforce_max_share(rows: DataFrame, beam: DataFrame, sources: DataFrame, max_share: float) -> DataFrame:
    """Tiles after swaps, one at a time the one that loses the least likeness, until no song of a target has more than its share."""
    starts = sources.select("source_id", "start_s")
    songs = tuple(r["song_id"] for r in sources.select("song_id").distinct().collect())  # source songs: a fixed handful
    own = rows.drop("start_s").join(starts, "source_id").select("target", "t", "source_id", "song_id", "start_s", "score", F.col("key_shift").cast("int").alias("key_shift"))
    other = beam.drop("start_s").join(starts, "source_id").select("target", "t", "j", "source_id", "song_id", "start_s", "score", F.col("key_shift").cast("int").alias("key_shift"))

    def swap(tile: pd.DataFrame, cand: pd.DataFrame) -> pd.DataFrame:
        # a swap takes from a song above its share and gives to one below: neither kind ever grows, and a tile that was swapped stays.
        # So the swaps, one by one the least loss that still fits, are one pass through all by loss.
        tile = tile.sort_values("t").reset_index(drop=True)
        limit = max(1, math.floor(max_share * len(tile)))
        place = {t: n for n, t in enumerate(tile["t"].tolist())}
        cand = cand[cand["t"].isin(place)].sort_values(["t", "j"])
        if max_share <= 0 or cand.empty:
            return tile
        at = cand["t"].map(place).to_numpy(np.int64)
        n = Counter(tile["song_id"])
        over, under = {s for s, c in n.items() if c > limit}, {s for s in {*songs, *n} if n[s] < limit}
        fits = tile["song_id"].isin(over).to_numpy()[at] & cand["song_id"].isin(under).to_numpy() & (cand["source_id"].to_numpy() != tile["source_id"].to_numpy()[at])
        loss = np.where(fits, tile["score"].to_numpy()[at] - cand["score"].to_numpy(), np.inf)
        taken = np.full(len(tile), -1)
        own, other = tile["song_id"].to_numpy(), cand["song_id"].to_numpy()
        for k in np.argsort(loss, kind="stable")[: fits.sum()].tolist():
            row = at[k]
            if taken[row] < 0 and n[own[row]] > limit and n[other[k]] < limit:
                taken[row] = k
                n[own[row]] -= 1
                n[other[k]] += 1
        swapped = taken >= 0
        for c in ("source_id", "song_id", "start_s", "score", "key_shift"):
            tile.loc[swapped, c] = cand[c].to_numpy()[taken[swapped]]
        return tile

    return _fresh(own).groupBy("target").cogroup(_fresh(other).groupBy("target")).applyInPandas(swap, TILES)


def _nearest(starts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in sorted `starts` of those nearest to `wanted`: the first of equally near ones."""
    after = np.minimum(np.searchsorted(starts, wanted), len(starts) - 1)
    before = np.maximum(after - 1, 0)
    at = np.where(np.abs(starts[before] - wanted) <= np.abs(starts[after] - wanted), before, after)
    while (same := (at > 0) & (np.abs(starts[at - 1] - wanted) == np.abs(starts[at] - wanted))).any():
        at = at - same
    return at


def enforce_min_runs(rows: DataFrame, sources: DataFrame, min_run: int, hop_s: float, max_share: float) -> DataFrame:
    """Tiles after short runs have been taken by a neighbour's song, whose clips go on from there; not beyond its share.

    Runs are those of the input; what earlier ones did counts for shares and positions.
    """

    names = [c.split()[0] for c in TILES.split(", ")]

    def absorb(tile: pd.DataFrame, clips: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("t")[names]
        col = {c: tile[c].to_numpy().copy() for c in ("source_id", "song_id", "start_s", "score", "key_shift")}
        song, place = tile["song_id"].to_numpy(), np.arange(len(tile))
        limit = max(1, math.floor(max_share * len(tile))) if max_share > 0 else len(tile)
        number = np.cumsum(np.append(False, song[1:] != song[:-1]))
        stretch = np.split(place, np.flatnonzero(np.diff(number)) + 1) if min_run > 1 and len(tile) >= min_run else []
        clips = clips.sort_values(["start_s", "source_id"])
        of_song = {s: (x["start_s"].to_numpy(), x["source_id"].to_numpy()) for s, x in clips.groupby("song_id")}
        count = Counter(song)
        for r, own in enumerate(stretch):
            sides = [(len(stretch[i]), stretch[i]) for i in (r - 1, r + 1) if 0 <= i < len(stretch)]
            if len(own) >= min_run or not sides:
                continue
            longest = max(sides, key=lambda x: x[0])[1]  # the left one of equal ones
            taker = song[longest[0]]
            if count[taker] + len(own) > limit or taker not in of_song:
                continue
            starts, ids = of_song[taker]
            count[taker] += len(own)
            count[song[own[0]]] -= len(own)
            # on from the left neighbour where it is of that song, else up to the right one
            left = r > 0 and song[stretch[r - 1][0]] == taker
            beside = own[0] - 1 if left else own[-1] + 1
            wanted = col["start_s"][beside] + hop_s * (np.arange(len(own)) + 1 if left else np.arange(len(own)) - len(own))
            nearest = _nearest(starts, wanted)
            col["source_id"][own], col["start_s"][own] = ids[nearest], starts[nearest]
            col["song_id"][own], col["key_shift"][own] = taker, col["key_shift"][beside]
            col["score"][own] *= 0.98
        return tile.assign(**col).astype({"source_id": "int64", "key_shift": "int32", "start_s": "float64"})

    clips = sources.select("song_id", "source_id", "start_s")
    starts = clips.select("source_id", F.col("start_s").alias("s"))
    own = (rows if "start_s" in rows.columns else rows.join(starts, "source_id").withColumnRenamed("s", "start_s")).select(*[c.split()[0] for c in TILES.split(", ")])
    # a target's tiles meet the clips of the songs they use
    used = rows.select("target", "song_id").distinct().join(clips, "song_id")
    return _fresh(own).groupBy("target").cogroup(_fresh(used).groupBy("target")).applyInPandas(absorb, TILES)
