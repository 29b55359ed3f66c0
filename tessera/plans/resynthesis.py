"""Registered queries of the factorisation renderer: a vector is a hop of sound, a frame two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import factorize, render, resynthesis
from ..sources import catalog
from .matching import ACT, POLY, SCORE, _act
from .registry import query

SIZE, HOP, SR, BLOCK = 128, 64, 291, 512
SMOOTH = 0.28
PICKS = f"""{SCORE}{ACT}{POLY},
pck AS (SELECT p.target, p.t - 1 AS t, p.source_id, p.song_id, s.segment_idx - 1 AS frame, h / greatest(sum(h) OVER (PARTITION BY p.target, p.t), 1e-8) AS h FROM pol p JOIN src s USING (source_id))"""
WAVES = """wvs AS (SELECT s.song_id, flatten(list(e ORDER BY segment_idx)) AS y FROM seg s JOIN raw r USING (source_id) GROUP BY s.song_id)"""
_TURN, _HANN = f"2 * pi() * ((b * k) % {SIZE}) / {SIZE}", f"(CAST(0.5 AS DOUBLE) - CAST(0.5 AS DOUBLE) * cos(2 * pi() * k / {SIZE}))"
_PAD = f"[CAST(0 AS DOUBLE) FOR k IN range(0, {SIZE // 2})]"
SPECTRA = f"""{WAVES},
wvb AS (SELECT b AS bin, [cos({_TURN}) * {_HANN} FOR k IN range(0, {SIZE})] AS c, [-sin({_TURN}) * {_HANN} FOR k IN range(0, {SIZE})] AS s FROM (SELECT unnest(range(0, {SIZE // 2 + 1})) AS b)),
pdd AS (SELECT song_id, {_PAD} || y || {_PAD} AS x, len(y) AS n FROM wvs),
fra AS (SELECT song_id, f, x[f * {HOP} + 1 : f * {HOP} + {SIZE}] AS v FROM (SELECT song_id, x, unnest(range(0, n // {HOP} + 1)) AS f FROM pdd)),
spc AS (SELECT song_id, f, bin, list_inner_product(v, c) AS re, list_inner_product(v, s) AS im FROM fra, wvb),
nrg AS (SELECT song_id, f, sum(sqrt(re * re + im * im)) AS energy FROM spc GROUP BY ALL),
atm AS (SELECT song_id, f, bin, re / (energy + 1e-8) AS re, im / (energy + 1e-8) AS im FROM spc JOIN nrg USING (song_id, f) WHERE (song_id, f) IN (SELECT (song_id, frame) FROM pck WHERE h > 0))"""
SOUND = f"""{SPECTRA},
mxd AS (SELECT p.target, p.t, a.bin, sum(h * a.re) AS re, sum(h * a.im) AS im, sum(h * sqrt(a.re * a.re + a.im * a.im)) AS m FROM pck p JOIN atm a ON a.song_id = p.song_id AND a.f = p.frame WHERE h > 0 GROUP BY ALL),
grd AS (SELECT n.song_id AS target, n.f AS t, w.bin, n.energy, coalesce(m.re, 0) AS re, coalesce(m.im, 0) AS im, coalesce(m.m, 0) AS m FROM nrg n CROSS JOIN wvb w LEFT JOIN mxd m ON m.target = n.song_id AND m.t = n.f AND m.bin = w.bin WHERE n.song_id LIKE 'T%'),
shp AS (SELECT *, m / greatest(sum(m) OVER (PARTITION BY target, t), 1e-8) AS s FROM grd),
smo AS (SELECT *, (1 - CAST({SMOOTH} AS DOUBLE)) * s + CAST({SMOOTH} AS DOUBLE) * (s / 2 + coalesce(lag(s) OVER w, s) / 4 + coalesce(lead(s) OVER w, s) / 4) AS b FROM shp WINDOW w AS (PARTITION BY target, bin ORDER BY t)),
mag AS (SELECT target, t, bin, re, im, energy * b / greatest(sum(b) OVER (PARTITION BY target, t), 1e-8) AS m FROM smo),
pol_ AS (SELECT target, t, bin, CASE WHEN re = 0 AND im = 0 THEN m ELSE m * re / sqrt(re * re + im * im) END AS re, CASE WHEN re = 0 AND im = 0 THEN 0 ELSE m * im / sqrt(re * re + im * im) END AS im FROM mag),
spl AS (SELECT target, t, list(re ORDER BY bin) AS re, list(im ORDER BY bin) AS im FROM pol_ GROUP BY ALL),
inv AS (SELECT k, {_HANN} AS h, [CASE WHEN b IN (0, {SIZE // 2}) THEN 1 ELSE 2 END * cos({_TURN}) / {SIZE} FOR b IN range(0, {SIZE // 2 + 1})] AS c, [CASE WHEN b IN (0, {SIZE // 2}) THEN 0 ELSE -2 END * sin({_TURN}) / {SIZE} FOR b IN range(0, {SIZE // 2 + 1})] AS s FROM (SELECT unnest(range(0, {SIZE})) AS k)),
tls_ AS (SELECT target, t * {HOP} + k - {SIZE // 2} AS i, h * (list_inner_product(re, c) + list_inner_product(im, s)) AS y, h * h AS w FROM spl, inv),
sms AS (SELECT target, i, sum(tls_.y) / greatest(sum(w), 1e-8) AS y FROM tls_ JOIN wvs ON song_id = target WHERE i >= 0 AND i < len(wvs.y) GROUP BY ALL),
snd AS (SELECT target, i, y * CASE WHEN max(abs(y)) OVER (PARTITION BY target) > 0.99 THEN CAST(0.99 AS DOUBLE) / max(abs(y)) OVER (PARTITION BY target) ELSE 1 END AS y FROM sms)"""


def _picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activations of each target row, of three songs at most, summing to 1; rows and frames from 0."""
    act = factorize.limit_polyphony(_act(spark, sf_dir)[0], 3)
    whole = act.groupBy("target", "t").agg(F.sum("h").alias("sum"))
    rows = act.join(whole, ["target", "t"])
    return rows.select("target", (F.col("t") - 1).alias("t"), F.col("source_id").alias("slot"), "song_id", (F.col("frame") - 1).alias("frame"), (F.col("h") / F.greatest("sum", F.lit(1e-8))).alias("h"))


def _waves(spark: SparkSession, sf_dir: str, targets: bool) -> DataFrame:
    e = catalog.table(spark, sf_dir, "embeddings").where("embedding is not null").where("label >= 5" if targets else "label < 5")
    song = F.concat(F.lit("T"), F.col("label").cast("string")) if targets else F.chr(F.col("label") + 65)
    return render.wave_blocks(e.select(song.alias("song_id"), F.lit("song").alias("kind"), F.col("vec_id").alias("piece"), F.transform("embedding", lambda x: x.cast("double")).alias("samples")), BLOCK)


@query("selected_atoms", f"WITH {PICKS}, {SPECTRA} SELECT song_id, f AS frame, bin, round(re, 6) + 0 AS re, CASE WHEN bin IN (0, {SIZE // 2}) THEN 0 ELSE round(im, 6) + 0 END AS im FROM atm")
def selected_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = resynthesis.selected_atoms(_picks(spark, sf_dir).where("h > 0"), _waves(spark, sf_dir, False), SIZE, HOP, BLOCK)
    rows = atoms.select("song_id", "frame", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "x"))
    return rows.select("song_id", "frame", F.col("bin").cast("long").alias("bin"), (F.round("x.re", 6) + 0.0).alias("re"), F.when(F.col("bin").isin(0, SIZE // 2), F.lit(0.0)).otherwise(F.round("x.im", 6) + 0.0).alias("im"))


@query("nmf_render", f'WITH {PICKS}, {SOUND} SELECT target, i AS "at", round(y, 6) + 0 AS y FROM snd')
def nmf_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample of every target, from source frames alone."""
    out = resynthesis.resynthesised(_picks(spark, sf_dir), _waves(spark, sf_dir, True), _waves(spark, sf_dir, False), SIZE, HOP, SMOOTH, block=BLOCK)
    rows = out.select("target", "block", F.posexplode("samples").alias("k", "y"))
    return rows.select("target", (F.col("block") * BLOCK + F.col("k")).alias("at"), (F.round("y", 6) + 0.0).alias("y"))


@query("nmf_picks", f"WITH {PICKS} SELECT target, t, song_id, round(frame * {HOP} / CAST({SR} AS DOUBLE), 6) AS source_s, round(h, 6) AS weight FROM pck QUALIFY row_number() OVER (PARTITION BY target, t ORDER BY h DESC, source_id) = 1")
def nmf_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resynthesis.frame_picks(_picks(spark, sf_dir), SR, HOP)
    return rows.select("target", "t", "song_id", F.round("source_s", 6).alias("source_s"), F.round("weight", 6).alias("weight"))
