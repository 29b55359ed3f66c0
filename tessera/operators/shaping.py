"""Loudness, attack and envelope of a sound brought towards a reference's: on waveforms in blocks, within the JVM.

Both sounds have one song_id; what a step needs of a whole sound is summed first. Blocks hold whole hops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import clip
from .blocks import haloed
from .render import BLOCK, peak
from .signals import loudness_gain


def _square(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)


def _sums(waves: DataFrame, name: str) -> DataFrame:
    """(song_id, {name}: rms, {name}_n) of whole sounds."""
    own = waves.groupBy("song_id").agg(F.sum(_square(F.col("samples"))).alias("s"), F.sum(F.size("samples")).cast("long").alias(f"{name}_n"))
    return own.select("song_id", F.sqrt(F.col("s") / F.col(f"{name}_n") + 1e-12).alias(name), f"{name}_n")


def _limited(waves: DataFrame, ceiling: float = 0.98) -> DataFrame:
    top = waves.groupBy("song_id").agg(F.max(peak(F.col("samples"))).alias("top"))
    scale = F.least(F.lit(1.0), ceiling / F.greatest("top", F.lit(1e-9)))
    return waves.join(top, "song_id").withColumn("samples", F.transform("samples", lambda x: x * scale)).drop("top")


def with_loudness(waves: DataFrame, reference: DataFrame, blend: float = 0.85) -> DataFrame:
    """waves at (reference's rms / own) ** blend, from .35 to 3.5 times, peaks at .98 at most. Sounds without a reference are left out."""
    both = _sums(waves, "own").join(_sums(reference, "ref"), "song_id").select("song_id", loudness_gain(F.col("own"), F.col("ref"), blend).alias("gain"))
    return _limited(waves.join(both, "song_id").withColumn("samples", F.transform("samples", lambda x: x * F.col("gain"))).drop("gain"))


def with_attack(waves: DataFrame, reference: DataFrame, sr: int, amount: float = 0.35, attack_s: float = 0.08, size: int = BLOCK) -> DataFrame:
    """waves whose first 80 ms are as loud against the whole as the reference's, to the power `amount` and .7 to 1.45 times, easing out in a line.

    Where either sound is shorter than a quarter of a second nothing changes.
    """
    n = _sums(waves, "own").join(_sums(reference, "ref"), "song_id").withColumn("n", F.least("own_n", "ref_n", F.lit(int(attack_s * sr))))
    start = F.col("block") * size

    def early(side: DataFrame, name: str) -> DataFrame:
        inside = F.slice("samples", F.lit(1), F.greatest(F.least(F.col("n") - start, F.size("samples")), F.lit(0)).cast("int"))
        own = side.join(n.select("song_id", "n"), "song_id").where(start < F.col("n")).groupBy("song_id").agg(F.sum(_square(inside)).alias("s"), F.max("n").alias("k"))
        return own.select("song_id", F.sqrt(F.col("s") / F.col("k") + 1e-12).alias(name))

    facts = n.join(early(waves, "own_early"), "song_id").join(early(reference, "ref_early"), "song_id")
    had = F.col("own_early") / (F.col("own") + 1e-8)
    ratio = F.col("ref_early") / (F.col("ref") + 1e-8) / had
    short = (F.least("own_n", "ref_n") < sr // 4) | (F.col("n") < 16) | (had < 1e-6)
    facts = facts.select("song_id", "n", F.when(short, F.lit(1.0)).otherwise(clip(F.pow(ratio, F.lit(amount)), 0.7, 1.45)).alias("gain"))
    ramp = lambda x, i: F.when(start + i < F.col("n"), x * (F.col("gain") + (1 - F.col("gain")) * (start + i) / F.greatest(F.col("n") - 1, F.lit(1)))).otherwise(x)
    return waves.join(facts, "song_id").withColumn("samples", F.transform("samples", ramp)).drop("n", "gain")


def _frames(waves: DataFrame, name: str, hop: int, size: int) -> DataFrame:
    """(song_id, f, {name}): rms of frames of two hops at every hop, cut at the end."""
    chunks = waves.select("song_id", "block", "samples", F.explode(F.expr(f"sequence(0, (size(samples) - 1) div {hop})")).alias("c"))
    part = F.slice("samples", F.col("c") * hop + 1, F.lit(hop))
    chunks = chunks.select("song_id", (F.col("block") * (size // hop) + F.col("c")).alias("f"), _square(part).alias("s"), F.size(part).alias("k"))
    twice = chunks.select("song_id", "s", "k", "f", F.explode(F.array("f", F.col("f") - 1)).alias("g")).where("g >= 0")
    return twice.groupBy("song_id", F.col("g").alias("f")).agg(F.sqrt(F.sum("s") / F.sum("k") + 1e-12).alias(name))


def with_envelope(waves: DataFrame, reference: DataFrame, blend: float = 0.85, hop: int = 256, size: int = BLOCK) -> DataFrame:
    """waves whose smoothed frame levels move towards the reference's: a ratio of .25 to 4, blended with 1, in lines between frames' middles; peaks at .98 at most.

    Levels are means of five frames, zeros beyond both ends. The reference counts as far as the sound goes, as silence beyond its own end.
    """
    if size % hop:
        raise ValueError("a block must hold whole hops")
    own = _frames(waves, "own", hop, size)
    levels = own.join(_frames(_cut_to(reference, waves, size), "ref", hop, size), ["song_id", "f"], "left").withColumn("ref", F.coalesce("ref", F.lit(1e-6)))
    top = own.groupBy("song_id").agg(F.max("f").alias("top"))
    rows, w = haloed(levels, ["song_id"], "f", 2, 2)
    wide = w.rowsBetween(-2, 2)
    rows = rows.select("song_id", "f", "_own", (F.sum("own").over(wide) / 5).alias("own"), (F.sum("ref").over(wide) / 5).alias("ref")).where("_own")
    gain = rows.select("song_id", "f", (1 + blend * (clip((F.col("ref") + 1e-8) / (F.col("own") + 1e-8), 0.25, 4.0) - 1)).alias("gain"))
    # a block of samples reads its own frames and the last one before it
    per = size // hop
    near = gain.select("song_id", F.explode(F.array_distinct(F.array(F.expr(f"f div {per}"), F.expr(f"(f + 1) div {per}")))).alias("block"), "f", "gain")
    near = near.groupBy("song_id", "block").agg(F.map_from_entries(F.collect_list(F.struct("f", "gain"))).alias("gains")).join(top, "song_id")
    place = lambda i: F.col("block") * size + i
    at = lambda f: F.element_at("gains", F.least(F.greatest(f, F.lit(0)), F.col("top")))

    def shaped(x: Column, i: Column) -> Column:
        f = F.floor(place(i) / hop)
        a, b = at(f - 1), at(f)
        return x * (a + (b - a) * F.when(place(i) < hop, F.lit(0.0)).otherwise(place(i) % hop / hop))

    out = waves.join(near, ["song_id", "block"]).withColumn("samples", F.transform("samples", shaped)).drop("gains", "top")
    return _limited(out)


def _cut_to(reference: DataFrame, waves: DataFrame, size: int) -> DataFrame:
    """The reference as far as the sound goes, silence where it is shorter."""
    n = waves.select("song_id", "block", F.size("samples").alias("n"))
    zeros = F.array_repeat(F.lit(0.0), F.greatest(F.col("n") - F.coalesce(F.size("samples"), F.lit(0)), F.lit(0)))
    cut = F.concat(F.slice(F.coalesce("samples", F.array().cast("array<double>")), F.lit(1), F.col("n")), zeros)
    return n.join(reference.select("song_id", "block", "samples"), ["song_id", "block"], "left").select("song_id", "block", cut.alias("samples"))
