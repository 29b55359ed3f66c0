"""The matcher from descriptors to tiles: search, decode, quotas, runs, layers, figures."""

from __future__ import annotations

from dataclasses import fields
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.costs import MatchParams
from ..sources.shared import written
from . import decode, search

# Allowed ranges of options.
RANGES = {"top_k": (1, 100), "lambda_switch": (0, 5), "lambda_jump": (0, 5), "lambda_self": (0, 5), "lambda_concat": (0, 5), "lambda_join": (0, 5), "lambda_duration": (0, 5), "lambda_balance": (0, 10), "balance_iters": (1, 8), "jump_norm_s": (0.01, 60), "hop_s": (0.02, 10), "per_song_k": (1, 100), "max_share": (0, 1), "min_run": (1, 64), "n_layers": (1, 8), "layer_primary_weight": (0, 1)}


def checked(p: MatchParams, window_s: float | None = None) -> MatchParams:
    """p, or ValueError where an option is out of range or the hop exceeds the window."""
    for f in fields(p):
        low, high = RANGES.get(f.name, (None, None))
        v = getattr(p, f.name)
        if low is not None and not low <= v <= high:
            raise ValueError(f"{f.name} must be from {low} to {high}")
    if window_s is not None and p.hop_s > window_s:
        raise ValueError("the hop is longer than the window")
    return p


class Mosaic(NamedTuple):
    tiles: DataFrame  # target, t, source_id, song_id, start_s, score, key_shift
    layers: DataFrame  # target, t, layer, source_id, song_id, weight
    summary: DataFrame  # target, tiles, transitions, greedy_transitions, similarity


def match_sequence(targets: DataFrame, sources: DataFrame, p: MatchParams = MatchParams(), weights: search.Weights = search.Weights()) -> Mosaic:
    """Each target row's source and layers. Diverse beams where likeness is not all; there quotas hold before and after runs are absorbed."""
    checked(p)
    quotas = not p.fidelity_first and p.max_share < 1
    beam = search.beam_topk(targets, sources, p.top_k, weights) if p.fidelity_first else search.beam_diverse(targets, sources, p.top_k, p.per_song_k, weights)
    beam = written(beam, "beam")  # every pass, the layers and the figures read it
    path = decode.balanced_path(beam, targets, sources, p)
    starts = sources.select("source_id", "start_s")
    rows = path.drop("cost").join(beam, ["target", "t", "j"]).join(starts, "source_id").select(*[c.split()[0] for c in decode.TILES.split(", ")])
    if quotas:
        rows = decode.enforce_max_share(rows, beam, sources, p.max_share)
    if p.min_run > 1:
        rows = decode.enforce_min_runs(rows, sources, p.min_run, p.hop_s, p.max_share)
        if quotas:
            rows = decode.enforce_max_share(rows, beam, sources, p.max_share)
    rows = written(rows, "tiles")
    layers = decode.layers(rows, beam, targets, sources, p)
    greedy = decode.transitions(beam.where("j = 1")).withColumnRenamed("transitions", "greedy_transitions")
    mean = rows.groupBy("target").agg(F.count("*").alias("tiles"), F.avg("score").alias("similarity"))
    return Mosaic(rows, layers, mean.join(decode.transitions(rows), "target").join(greedy, "target"))
