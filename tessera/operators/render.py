"""The unit renderer: clips of stored waveforms, mixed a tile and added up where they overlap.

Waveforms are stored in blocks, (song_id, kind, block, samples): kind 'song' is the whole sound, 'drums', 'bass', 'other' and 'vocals'
are its stems. A clip reads the blocks that it touches, tiles meet only in sums a sample, so a target of any length is many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import fit_length
from ..functions.costs import fade_in, fade_out
from ..functions.vectors import clip, total
from ..sources.shared import written
from .numbering import dense_index, numbered

BLOCK = 4096  # samples
STEMS = ("drums", "bass", "other", "vocals")
# which stems a role is heard from, and how loud
MIXES = {"drums": {"drums": 1.0}, "bass": {"bass": 1.0}, "harmonic": {"other": 0.65, "vocals": 0.35}, "full": dict.fromkeys(STEMS, 0.5)}


def wave_blocks(pieces: DataFrame, size: int = BLOCK) -> DataFrame:
    """Pieces (song_id, kind, piece, samples), which follow each other in order of `piece`, as blocks of `size` samples."""
    rows = numbered(pieces.where(F.size("samples") > 0), ["piece"], ["song_id", "kind"], "at", F.size("samples").cast("long"))
    rows = rows.withColumn("block", F.explode(F.expr(f"sequence(at div {size}, (at + size(samples) - 1) div {size})")))
    start = F.col("block") * size - F.col("at")  # of the block, in the piece
    low, high = F.greatest(start, F.lit(0)), F.least(start + size, F.size("samples"))
    part = F.slice("samples", (low + 1).cast("int"), (high - low).cast("int"))
    cut = rows.select("song_id", "kind", "block", F.struct((low - start).alias("off"), part.alias("part")).alias("cut"))
    return _joined(cut, ["song_id", "kind", "block"])


def _joined(cuts: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of each key, laid end to end by their offset: as many as the key's own length holds."""
    parts = cuts.groupBy(*keys).agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    return parts.select(*keys, F.flatten(F.transform("cuts", lambda c: c["part"])).alias("samples"))


def stretches(asked: DataFrame, waves: DataFrame, keys: list[str], size: int = BLOCK, gain: Column | None = None) -> DataFrame:
    """asked (keys..., with song_id, kind, a, n among them, each once) with `samples`: n from place a on, which may lie before the start.

    Only the blocks that a stretch touches are joined. Places outside the song are silent; a stretch that lies outside altogether has no row.
    """
    parts = asked.withColumn("block", F.explode(F.expr(f"sequence(greatest(a, 0L) div {size}, greatest(a + n - 1, 0L) div {size})")))
    start = F.col("block") * size
    low, high = F.greatest(F.col("a") - start, F.lit(0)), F.least(F.col("a") + F.col("n") - start, F.size("samples"))
    hit = parts.join(waves, ["song_id", "kind", "block"]).where(high > low)
    part = F.slice("samples", (low + 1).cast("int"), (high - low).cast("int"))
    if gain is not None:
        part = F.transform(part, lambda x: x * gain)
    cuts = hit.select(*keys, F.struct((start + low - F.col("a")).alias("off"), part.alias("part")).alias("cut"))
    cuts = cuts.groupBy(*keys).agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    lead = F.array_repeat(F.lit(0.0), F.get("cuts", F.lit(0))["off"].cast("int"))
    return cuts.select(*keys, fit_length(F.concat(lead, F.flatten(F.transform("cuts", lambda c: c["part"]))), F.col("n")).alias("samples"))


def _mix(role: Column) -> Column:
    """(kind, gain) of the stems of a role."""
    of = lambda m: F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(g).alias("gain")) for k, g in m.items()])
    out = of(MIXES["full"])
    for name in ("drums", "bass", "harmonic"):
        out = F.when(role == name, of(MIXES[name])).otherwise(out)
    return out


def layer_clips(layers: DataFrame, waves: DataFrame, size: int = BLOCK) -> DataFrame:
    """layers (song_id, role, a, n, ...) with `samples`: n from place a of the song on, of its role's stems where it has stems; silence beyond its end.

    Equal requests are cut once and joined back. waves: as from wave_blocks(), with blocks of the same size.
    """
    request = ["song_id", "role", "a", "n"]
    stems = waves.where("kind <> 'song'").select("song_id").distinct().withColumn("stems", F.lit(True))
    asked = layers.select(*request).where("n > 0 and a >= 0").distinct().join(stems, "song_id", "left")
    song = F.array(F.struct(F.lit("song").alias("kind"), F.lit(1.0).alias("gain")))
    parts = asked.select(*request, F.inline(F.when(F.col("stems"), _mix(F.col("role"))).otherwise(song)))
    kinds = stretches(parts, waves, [*request, "kind"], size, F.col("gain"))
    clips = kinds.groupBy(*request).agg(F.array_sort(F.collect_list(F.struct("kind", "samples"))).alias("kinds"))
    silent = F.array_repeat(F.lit(0.0), F.col("n").cast("int"))
    heard = F.aggregate("kinds", silent, lambda s, k: F.zip_with(s, k["samples"], lambda x, y: x + y))
    clips = clips.select(*request, heard.alias("samples"))
    return layers.join(clips, request, "left").withColumn("samples", F.coalesce("samples", silent))


REQUEST = ["song_id", "role", "a", "source_n", "n", "steps"]


def clip_requests(layers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct requests with their number and pace, layers with their request's number).

    layers: (song_id, role, a, source_n, n, steps, ...): source_n samples from place a on, to be shifted by so many semitones and played in n
    samples. Steps count to a tenth, so clips that can't be told apart are made once; the pace stays within half and twice.
    """
    rows = layers.withColumn("steps", F.round("steps", 1) + 0.0)
    requests, numbered_layers = dense_index(rows, REQUEST, "request")
    pace = clip(F.col("source_n") / F.col("n"), 0.5, 2.0)
    return requests.withColumn("pace", pace), numbered_layers


def peak(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(x, lambda v: F.abs(v))), F.lit(0.0))


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once: written out, an expression within a lambda is computed again for every sample."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _limited(x: Column, ceiling: float = 0.99) -> Column:
    return _once(x, lambda y: _once(peak(y), lambda top: F.when(top > ceiling, _once(ceiling / top, lambda gain: F.transform(y, lambda v: v * gain))).otherwise(y)))


def _centred(x: Column) -> Column:
    def moved(y: Column) -> Column:
        mean = total(y) / F.greatest(F.size(y), F.lit(1))
        return _once(mean, lambda m: F.when(F.abs(m) < 0.2 * (peak(y) + 1e-9), F.transform(y, lambda v: v - m)).otherwise(y))

    return _once(x, moved)


def tile_mixes(clips: DataFrame) -> DataFrame:
    """(target, place, samples): a tile's first layer with the others added in turn, limited, freed of a small constant offset.

    clips: (target, place, layer, weight, samples), all of a tile of one length. Offsets of a fifth of the peak and more are sound.
    """
    amount = clip(F.col("weight") * 1.35, 0.12, 0.55)
    tiles = clips.groupBy("target", "place").agg(F.array_sort(F.collect_list(F.struct("layer", amount.alias("amount"), "samples"))).alias("layers"))
    more = F.slice("layers", 2, F.greatest(F.size("layers") - 1, F.lit(0)))
    mix = F.aggregate(more, F.get("layers", F.lit(0))["samples"], lambda m, p: _limited(F.zip_with(m, p["samples"], lambda x, y: x + p["amount"] * y)))
    return tiles.select("target", "place", _centred(mix).alias("samples"))


def _shifted(rows: DataFrame, by: int, **names: str) -> DataFrame:
    """Of the row `by` places on: rows of (target, place) with the named columns' values there. An equi-join, as a target may be long."""
    return rows.select("target", (F.col("place") - by).alias("place"), *(F.col(c).alias(n) for n, c in names.items()))


def planned(tiles: DataFrame, sr: int, window_s: float = 0.45, onsets: DataFrame | None = None) -> DataFrame:
    """(target, place, pos, length, fade_in, fade_out, power, n_out): where each tile sounds and how it meets its neighbours.

    tiles: (target, place from 0 without gaps, start_s, duration_s, song_id, source_s). A tile sounds for its own duration (of .12 s to two
    windows) or to the end of its seam with the next. Seams last 30 ms or half of either span, at least 4 ms (or 16 samples);
    a third of that where an onset (target, at) is within 20 ms. Seams are `power` ones unless the source just goes on.
    """
    guard, tolerance = max(16, round(0.004 * sr)), round(0.020 * sr)
    own = tiles.select("target", "place", "song_id", "source_s", F.rint(F.col("start_s") * sr).cast("long").alias("pos"), F.rint(clip(F.coalesce("duration_s", F.lit(window_s)), 0.12, 2 * window_s) * sr).cast("long").alias("win"))
    ends = tiles.groupBy("target").agg(F.rint((F.max_by("start_s", "place") + window_s) * sr).cast("long").alias("n_out"))
    own = own.join(_shifted(own, 1, edge="pos", next_song="song_id", next_s="source_s"), ["target", "place"], "left")
    own = own.withColumn("span", F.greatest(F.lit(1), F.coalesce(F.col("edge") - F.col("pos"), F.col("win"))))
    own = own.join(_shifted(own, 1, next_span="span"), ["target", "place"], "left")
    xf = F.least(F.lit(round(0.030 * sr)), F.expr("span div 2"), F.expr("next_span div 2"))
    seam = F.greatest(xf, F.least(F.lit(guard), F.col("span"), F.col("next_span")))
    if onsets is not None:
        bins = own.where("edge is not null").select("target", "place", "edge", F.explode(F.expr(f"sequence(edge div {tolerance + 1} - 1, edge div {tolerance + 1} + 1)")).alias("bin"))
        near = bins.join(onsets.select("target", "at", F.expr(f"at div {tolerance + 1}").alias("bin")), ["target", "bin"]).where(F.abs(F.col("at") - F.col("edge")) <= tolerance)
        own = own.join(near.select("target", "place").distinct().withColumn("near", F.lit(True)), ["target", "place"], "left")
        short = F.greatest(F.lit(1), F.least(F.greatest(F.lit(guard), F.rint(xf * 0.35).cast("long")), F.col("span"), F.col("next_span")))
        seam = F.when(F.col("near"), F.least(seam, short)).otherwise(seam)
    step = F.greatest(F.lit(1), F.col("edge") - F.col("pos")) / sr
    goes_on = (F.col("song_id") == F.col("next_song")) & (F.abs(F.col("source_s") + step - F.col("next_s")) <= F.greatest(F.lit(0.06), step * 0.55))
    own = own.withColumns({"fade_out": F.when(F.col("edge").isNull(), F.lit(0)).otherwise(seam).cast("long"), "power_next": F.col("edge").isNotNull() & ~goes_on})
    own = own.join(_shifted(own, -1, fade_in="fade_out", power="power_next"), ["target", "place"], "left").join(ends, "target")
    length = F.greatest(F.col("win"), F.col("span") + F.col("fade_out"))
    return own.select("target", "place", "pos", length.alias("length"), F.coalesce("fade_in", F.lit(0)).cast("long").alias("fade_in"), "fade_out", F.coalesce("power", F.lit(False)).alias("power"), "n_out")


def overlapped(tiles: DataFrame, sr: int, ceiling: float = 0.99) -> DataFrame:
    """(target, at, y): the sound of all tiles. tiles: as from planned(), with samples of `length`.

    Sums of w x, w and w^2 of each sample are taken at once. The divisor is the sum of weights; in a power seam it eases to the root of
    the sum of squares and back, by sin^2. Both ends of a target ramp over 4 ms, and a target of a larger peak is scaled to
    the ceiling. Samples that no tile covers are silent and have no row.
    """
    guard = max(16, round(0.004 * sr))
    k, fall = F.col("k"), F.col("length") - F.col("fade_out")
    # outer, as Spark else makes a filter of what `samples` are computed by, before the join; rows without samples go by `at`
    rows = tiles.where("pos < n_out").select("target", "pos", "length", "fade_in", "fade_out", "power", "n_out", F.posexplode_outer("samples").alias("k", "x"))
    w = F.when(k < F.col("fade_in"), fade_in(k, F.col("fade_in"))).otherwise(F.lit(1.0)) * F.when(k >= fall, fade_out(k - fall, F.col("fade_out"))).otherwise(F.lit(1.0))
    eased = F.pow(F.sin(F.pi() * k / F.greatest(F.col("fade_in") - 1, F.lit(1))), F.lit(2.0))
    rows = rows.select("target", (F.col("pos") + k).alias("at"), "x", w.alias("w"), F.when(F.col("power") & (k < F.col("fade_in")), eased).otherwise(F.lit(0.0)).alias("ease"), "n_out").where("at < n_out")
    # seams are shorter than spans: a sample lies in one at most
    sums = rows.groupBy("target", "at").agg(F.sum(F.col("w") * F.col("x")).alias("s"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("w2"), F.max("ease").alias("ease"), F.max("n_out").alias("n_out"))
    by = (1 - F.col("ease")) * F.col("w") + F.col("ease") * F.sqrt(F.greatest(F.col("w2"), F.lit(1e-12)))
    y = F.when(by > 1e-6, F.col("s") / by).otherwise(F.col("s"))
    ends = F.least(F.lit(guard), F.expr("n_out div 2"))
    ramp = lambda i: F.when((ends > 1) & (i < ends), F.sin(F.pi() / 2 * i / (ends - 1))).otherwise(F.lit(1.0))
    out = sums.select("target", "at", (y * ramp(F.col("at")) * ramp(F.col("n_out") - 1 - F.col("at"))).alias("y"))
    top = out.groupBy("target").agg(F.max(F.abs("y")).alias("top"))
    return out.join(top, "target").select("target", "at", F.when(F.col("top") > ceiling, F.col("y") * (ceiling / F.col("top"))).otherwise(F.col("y")).alias("y"))


def rendered(tiles: DataFrame, layers: DataFrame, waves: DataFrame, sr: int, window_s: float = 0.45, onsets: DataFrame | None = None, size: int = BLOCK) -> DataFrame:
    """(target, at, y): tiles (see planned()) of layers (target, place, layer, song_id, role, source_s, weight), cut from waves."""
    # written before and after: the plan meets its own rows several times, and all that made them would be planned as often
    plan = written(planned(written(tiles, "tiles"), sr, window_s, onsets), "plan")
    wanted = layers.join(plan.select("target", "place", F.col("length").alias("n")), ["target", "place"]).withColumn("a", F.rint(F.col("source_s") * sr).cast("long"))
    return overlapped(plan.join(tile_mixes(layer_clips(wanted, waves, size)), ["target", "place"]), sr)
