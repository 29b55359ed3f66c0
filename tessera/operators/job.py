"""The whole job: from descriptors and waveforms to tiles, both renderings, their measures, the choice between them, and documents."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.costs import MatchParams, improves, role
from ..sources.documents import documents
from ..sources.shared import written
from . import factorize, mosaic, render, resynthesis, search
from .quality import compared

BACKENDS = ("auto", "unit", "nmf")


@dataclass(frozen=True)
class JobParams:
    """Options of the renderers; those of the matcher are MatchParams."""

    sr: int = 22_050
    window_s: float = 0.45
    size: int = 1024
    hop: int = 512
    polyphony: int = 5
    smoothing: float = 0.28
    backend: str = "auto"
    block: int = render.BLOCK


class Job(NamedTuple):
    tiles: DataFrame  # target, t, source_id, song_id, start_s, score, key_shift
    layers: DataFrame  # target, t, layer, source_id, song_id, weight
    unit: DataFrame  # target's waveform in blocks
    nmf: DataFrame | None
    quality: DataFrame  # target, unit and nmf (structs of measures), backend
    sound: DataFrame  # the chosen rendering in blocks
    documents: DataFrame  # target, document (JSON)


def as_waves(samples: DataFrame, size: int) -> DataFrame:
    """(target, at, y) as a waveform in blocks; places without a row are silent."""
    rows = samples.groupBy(F.col("target").alias("song_id"), F.expr(f"at div {size}").alias("block")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("at") % size).cast("int").alias("k"), "y"))).alias("y"), F.max(F.col("at") % size).cast("int").alias("n"))
    last = rows.groupBy("song_id").agg(F.max("block").alias("last"))
    rows = rows.join(last, "song_id").withColumn("n", F.when(F.col("block") < F.col("last"), F.lit(size - 1)).otherwise(F.col("n")))
    return rows.select("song_id", F.lit("song").alias("kind"), "block", F.transform(F.sequence(F.lit(0), "n"), lambda k: F.coalesce(F.element_at("y", k), F.lit(0.0))).alias("samples"))


def run_job(targets: DataFrame, sources: DataFrame, target_waves: DataFrame, source_waves: DataFrame, p: JobParams = JobParams(), match: MatchParams = MatchParams(), activations: DataFrame | None = None, onsets: DataFrame | None = None) -> Job:
    """All targets at once. targets, sources: descriptors (see catalog); waves: in blocks, by song_id.

    activations: (target, t from 0, slot, song_id, frame, h) at the renderer's hop; without them, each target row's nearest clips of every song
    at their frames. Backend 'unit' renders tiles, 'nmf' frames, 'auto' takes frames where they are better than tiles.
    """
    if p.backend not in BACKENDS:
        raise ValueError(f"backend must be one of {', '.join(BACKENDS)}")
    found = mosaic.match_sequence(targets, sources, match)
    tiles, layers = written(found.tiles, "tiles"), written(found.layers, "layers")
    first = F.min("segment_idx").alias("first")
    goal = targets.join(targets.groupBy("song_id").agg(first), "song_id")
    goal = goal.select(F.col("song_id").alias("target"), F.col("segment_idx").alias("t"), (F.col("segment_idx") - F.col("first")).alias("place"), "start_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"))
    clips = sources.select("source_id", F.col("start_s").alias("source_s"), role("register", "energy").alias("role"))
    heard = goal.join(tiles.select("target", "t", "song_id", F.col("start_s").alias("source_s")), ["target", "t"])
    wanted = layers.join(clips, "source_id").join(goal.select("target", "t", "place"), ["target", "t"]).drop("t")
    unit = written(as_waves(render.rendered(heard.drop("t"), wanted, source_waves, p.sr, p.window_s, onsets, p.block), p.block), "unit")
    edges = goal.where("place > 0").select("target", F.rint(F.col("start_s") * p.sr).cast("long").alias("at"))
    metric = F.struct("chroma", "onset", "log_mel", "boundary")
    rows = compared(target_waves, unit, p.sr, edges, p.block).select("target", metric.alias("unit"))
    nmf = None
    if p.backend != "unit":
        if activations is None:
            activations = _nearest_activations(targets, sources, goal, p)
        made = resynthesis.resynthesised(activations, target_waves, source_waves.where("kind = 'song'"), p.size, p.hop, p.smoothing, unit, block=p.block)
        nmf = written(made.select(F.col("target").alias("song_id"), F.lit("song").alias("kind"), "block", "samples"), "nmf")
        other = compared(target_waves, nmf, p.sr, edges, p.block).select("target", metric.alias("nmf"))
        better = F.lit(True) if p.backend == "nmf" else improves("unit", "nmf")
        rows = rows.join(other, "target").withColumn("backend", F.when(better, "nmf").otherwise("unit"))
    else:
        rows = rows.withColumns({"nmf": F.lit(None).cast("struct<chroma: double, onset: double, log_mel: double, boundary: double>"), "backend": F.lit("unit")})
    quality = written(rows.select("target", "unit", "nmf", "backend"), "quality")
    both = unit.withColumn("backend", F.lit("unit"))
    if nmf is not None:
        both = both.unionByName(nmf.withColumn("backend", F.lit("nmf")))
    sound = both.join(quality.select(F.col("target").alias("song_id"), "backend"), ["song_id", "backend"], "left_semi")
    taken = quality.select("target", F.struct("backend", F.when(F.col("backend") == "nmf", F.col("nmf")).otherwise(F.col("unit")).alias("quality"), "unit", "nmf").alias("render"))
    docs = documents(tiles, layers).join(taken, "target")
    merged = F.concat(F.expr("substring(document, 1, length(document) - 1)"), F.lit(',"render":'), F.to_json("render"), F.lit("}"))
    return Job(tiles, layers, unit, nmf, quality, sound, docs.select("target", merged.alias("document")))


def _nearest_activations(targets: DataFrame, sources: DataFrame, goal: DataFrame, p: JobParams) -> DataFrame:
    """Each frame's picks: the nearest clip of every song for the row that sounds there, the `polyphony` best, by likeness; clips move on with their frames."""
    near = factorize.nearest_per_song(search.scored(targets, sources, 1, True), 1).withColumn("h", F.greatest("score", F.lit(0.0)))
    act = factorize.limit_polyphony(near, p.polyphony).where("h > 0").join(sources.select("source_id", F.col("start_s").alias("source_s")), "source_id")
    rows = act.join(goal, ["target", "t"])
    # a row holds the frames from its start to the next one's
    frame = lambda s: F.rint(F.col(s) * p.sr / p.hop).cast("long")
    nxt = goal.select("target", (F.col("place") - 1).alias("place"), F.col("start_s").alias("next_s"))
    rows = rows.join(nxt, ["target", "place"], "left").withColumn("last", F.greatest(frame("start_s"), F.coalesce(frame("next_s"), frame("start_s") + F.rint(F.lit(p.window_s * p.sr / p.hop)).cast("long")) - 1))
    rows = rows.withColumn("f", F.explode(F.sequence(frame("start_s"), F.col("last")))).withColumn("frame", frame("source_s") + F.col("f") - frame("start_s"))
    whole = rows.groupBy("target", "f").agg(F.sum("h").alias("whole"))
    rows = rows.join(whole, ["target", "f"])
    return rows.select("target", F.col("f").alias("t"), F.col("source_id").alias("slot"), "song_id", "frame", (F.col("h") / F.greatest("whole", F.lit(1e-8))).alias("h"))
