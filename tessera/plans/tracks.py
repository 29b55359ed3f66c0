"""Registered queries on tracks: vectors laid end to end as samples, and tones of known pitch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audio, index, quality, render, resynthesis, segments, shaping
from ..sources import catalog, shared, sound
from .matching import beam_sql, _beam
from .registry import query

SR = 400  # of tracks of 512 samples, so that they last over a second
TRK = "trk AS (SELECT CAST(vec_id // 8 AS BIGINT) AS n, 't' || CAST(vec_id // 8 AS VARCHAR) AS song_id, flatten(list([CAST(x AS DOUBLE) FOR x IN embedding] ORDER BY vec_id)) AS y FROM embeddings GROUP BY ALL)"
PAR = TRK + ",\npar AS (SELECT b.song_id, a.y AS r, b.y AS e FROM trk a JOIN trk b ON b.n = a.n + 1)"
ROWS = PAR + ",\nsam AS (SELECT song_id, unnest(range(0, len(e))) AS i, unnest(e) AS e, unnest(list_resize(r, len(e), CAST(0 AS DOUBLE))) AS r FROM par)"


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = catalog.table(spark, sf_dir, "embeddings").where("embedding is not null")
    parts = e.groupBy(F.floor(F.col("vec_id") / 8).alias("n")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("parts"))
    return parts.select("n", F.concat(F.lit("t"), F.col("n").cast("string")).alias("song_id"), F.lit(SR).alias("sr"), F.flatten(F.transform("parts", lambda p: p["embedding"])).alias("samples"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each track as the estimate of the one before it."""
    t = _tracks(spark, sf_dir)
    before = t.select((F.col("n") + 1).alias("n"), F.col("samples").alias("reference"))
    return t.join(before, "n").select("song_id", "sr", "reference", F.col("samples").alias("estimate"))


BLOCK = 256


def _waves(rows: DataFrame, column: str) -> DataFrame:
    """A column of whole tracks as waveforms in blocks."""
    return render.wave_blocks(rows.select("song_id", F.lit("song").alias("kind"), F.lit(0).alias("piece"), F.transform(column, lambda x: x.cast("double")).alias("samples")), BLOCK)


def _shaped(spark: SparkSession, sf_dir: str, how: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(song_id, i, y) of every track shaped after the one before it."""
    rows = _pairs(spark, sf_dir)
    out = how(_waves(rows, "estimate"), _waves(rows, "reference")).select("song_id", "block", F.posexplode("samples").alias("k", "y"))
    return out.select("song_id", (F.col("block") * BLOCK + F.col("k")).alias("i"), F.round("y", 6).alias("y"))


def stft_sql(name: str, source: str, size: int, hop: int) -> str:
    """Common table expressions up to `name` (song_id, frame, bin, mag) of source (song_id, y): inner products with windowed waves."""
    turn, hann = f"2 * pi() * ((b * k) % {size}) / {size}", f"(CAST(0.5 AS DOUBLE) - CAST(0.5 AS DOUBLE) * cos(2 * pi() * k / {size}))"
    pad = f"[CAST(0 AS DOUBLE) FOR k IN range(0, {size // 2})]"
    return f"""{name}_w AS (SELECT b AS bin, [cos({turn}) * {hann} FOR k IN range(0, {size})] AS c, [sin({turn}) * {hann} FOR k IN range(0, {size})] AS s FROM (SELECT unnest(range(0, {size // 2 + 1})) AS b)),
{name}_p AS (SELECT song_id, {pad} || y || {pad} AS x FROM {source}),
{name}_f AS (SELECT song_id, f, x[f * {hop} + 1 : f * {hop} + {size}] AS v FROM (SELECT song_id, x, unnest(range(0, (len(x) - {size}) // {hop} + 1)) AS f FROM {name}_p)),
{name} AS (SELECT song_id, f AS frame, bin, sqrt(power(list_inner_product(v, c), 2) + power(list_inner_product(v, s), 2)) AS mag FROM {name}_f, {name}_w)"""


@query("stft_magnitude", f"WITH {TRK}, {stft_sql('spc', 'trk', 64, 32)} SELECT song_id, frame, bin, round(mag, 6) AS magnitude FROM spc")
def stft_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    waves = _waves(_tracks(spark, sf_dir), "samples")
    rows = resynthesis.spectra(waves, 64, 32, BLOCK).select("song_id", "frame", F.posexplode("magnitude").alias("bin", "magnitude"))
    return rows.select("song_id", "frame", F.col("bin").cast("long").alias("bin"), F.round("magnitude", 6).alias("magnitude"))


EDGE = 256
_LIMITS = np.geomspace(1, EDGE // 2, 14).astype(int).tolist()
EDGES = f"""{TRK},
cut AS (SELECT song_id, 'head' AS side, list_resize(y[1:{EDGE}], {EDGE}, CAST(0 AS DOUBLE)) AS v FROM trk UNION ALL SELECT song_id, 'tail', list_resize(y[greatest(1, len(y) - {EDGE - 1}):], {EDGE}, CAST(0 AS DOUBLE)) FROM trk),
wav AS (SELECT b AS bin, [cos(2 * pi() * ((b * k) % {EDGE}) / {EDGE}) * (CAST(0.5 AS DOUBLE) - CAST(0.5 AS DOUBLE) * cos(2 * pi() * k / {EDGE - 1})) FOR k IN range(0, {EDGE})] AS c, [sin(2 * pi() * ((b * k) % {EDGE}) / {EDGE}) * (CAST(0.5 AS DOUBLE) - CAST(0.5 AS DOUBLE) * cos(2 * pi() * k / {EDGE - 1})) FOR k IN range(0, {EDGE})] AS s FROM (SELECT unnest(range(0, {EDGE // 2 + 1})) AS b)),
lim AS (SELECT unnest(range(0, 13)) AS k, unnest({_LIMITS[:-1]}) AS lo, unnest({_LIMITS[1:]}) AS hi),
bnd AS (SELECT song_id, side, k, ln(1 + coalesce(avg(sqrt(power(list_inner_product(v, c), 2) + power(list_inner_product(v, s), 2))), 0)) AS x FROM cut CROSS JOIN lim LEFT JOIN wav ON bin >= lo AND bin < hi GROUP BY ALL),
lst AS (SELECT song_id, side, list(x ORDER BY k) AS b FROM bnd GROUP BY ALL),
edg AS (SELECT song_id, side, b || [sqrt(list_inner_product(v, v) / {EDGE}), list_avg([abs(b[k + 1] - b[k]) FOR k IN range(1, 13)])] AS e FROM lst JOIN cut USING (song_id, side))"""


def _edges(tracks: DataFrame) -> DataFrame:
    """(song_id, head, tail), all clips of a batch at once."""
    clips = tracks.select(F.col("n").alias("source_id"), "samples")
    return index.built(tracks.select(F.col("n").alias("source_id"), "song_id"), clips, SR)


@query("edge_fingerprints", f"WITH {EDGES}, u AS (SELECT song_id, side, unnest(range(0, 15)) AS k, unnest(e) AS x, sqrt(list_inner_product(e, e)) + 1e-8 AS n FROM edg) SELECT song_id, k, round(max(x / n) FILTER (WHERE side = 'head'), 6) AS head, round(max(x / n) FILTER (WHERE side = 'tail'), 6) AS tail FROM u GROUP BY song_id, k")
def edge_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _edges(_tracks(spark, sf_dir)).select("song_id", F.posexplode(F.arrays_zip("head", "tail")).alias("k", "x"))
    return rows.select("song_id", F.col("k").cast("long").alias("k"), F.round("x.head", 6).alias("head"), F.round("x.tail", 6).alias("tail"))


@query("loudness_match", f"WITH {ROWS}, lev AS (SELECT song_id, sqrt(list_inner_product(r, r) / len(r) + 1e-12) AS a, sqrt(list_inner_product(e, e) / len(e) + 1e-12) AS b FROM par), g AS (SELECT song_id, least(greatest(power(a / greatest(b, 1e-6), CAST(0.85 AS DOUBLE)), 0.35), 3.5) AS g FROM lev), o AS (SELECT song_id, i, e * g AS y FROM sam JOIN g USING (song_id)) SELECT song_id, i, round(y * least(1, 0.98 / greatest(max(abs(y)) OVER (PARTITION BY song_id), 1e-9)), 6) AS y FROM o")
def loudness_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shaped(spark, sf_dir, shaping.with_loudness)


@query(
    "transient_match",
    f"WITH {PAR}, a AS (SELECT *, CAST(least(len(e), len(r), {8 * SR // 100}) AS BIGINT) AS n FROM par), q AS (SELECT *, sqrt(list_inner_product(e[1:n], e[1:n]) / n + 1e-12) / (sqrt(list_inner_product(e, e) / len(e) + 1e-12) + 1e-8) AS own, sqrt(list_inner_product(r[1:n], r[1:n]) / n + 1e-12) / (sqrt(list_inner_product(r, r) / len(r) + 1e-12) + 1e-8) AS goal FROM a), "
    "g AS (SELECT *, least(greatest(power(goal / own, CAST(0.35 AS DOUBLE)), CAST(0.7 AS DOUBLE)), CAST(1.45 AS DOUBLE)) AS g FROM q), s AS (SELECT song_id, n, g, unnest(range(0, len(e))) AS i, unnest(e) AS y FROM g) SELECT song_id, i, round(CASE WHEN i < n THEN y * (g + (1 - g) * i / (n - 1)) ELSE y END, 6) AS y FROM s",
)
def transient_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shaped(spark, sf_dir, lambda own, ref: shaping.with_attack(own, ref, SR, size=BLOCK))


@query(
    "envelope_match",
    f"WITH {ROWS}, f AS (SELECT s.song_id, k.f, sqrt(avg(e * e) + 1e-12) AS le, sqrt(avg(r * r) + 1e-12) AS lr FROM sam s JOIN (SELECT DISTINCT song_id, i // 32 AS f FROM sam) k ON k.song_id = s.song_id AND s.i >= k.f * 32 AND s.i < k.f * 32 + 64 GROUP BY ALL), "
    "c AS (SELECT song_id, f, sum(le) OVER w / 5 AS ce, sum(lr) OVER w / 5 AS cr, max(f) OVER (PARTITION BY song_id) AS top FROM f WINDOW w AS (PARTITION BY song_id ORDER BY f ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), g AS (SELECT song_id, f, top, 1 + CAST(0.85 AS DOUBLE) * (least(greatest((cr + 1e-8) / (ce + 1e-8), 0.25), 4) - 1) AS g FROM c), "
    "o AS (SELECT s.song_id, s.i, s.e * (a.g + (b.g - a.g) * CASE WHEN s.i < 32 THEN 0 ELSE (s.i % 32) / CAST(32 AS DOUBLE) END) AS y FROM sam s JOIN g a ON a.song_id = s.song_id AND a.f = least(greatest(s.i // 32 - 1, 0), a.top) JOIN g b ON b.song_id = s.song_id AND b.f = least(greatest(s.i // 32, 0), b.top)) "
    "SELECT song_id, i, round(y * least(1, 0.98 / greatest(max(abs(y)) OVER (PARTITION BY song_id), 1e-9)), 6) AS y FROM o",
)
def envelope_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shaped(spark, sf_dir, lambda own, ref: shaping.with_envelope(own, ref, hop=32, size=BLOCK))


def _mel_sql(size: int) -> str:
    """Mean relative difference of log mel power at one resolution, as table m{size} (song_id, d)."""
    s, step = size, f"(2595 * log10(1 + CAST({SR / 2} AS DOUBLE) / 700)) / 65"
    edge = lambda k: f"(700 * (power(10, ({k}) * {step} / 2595) - 1))"
    f = f"(bin * CAST({SR} AS DOUBLE) / {s})"
    return f"""{stft_sql(f'a{s}', 'ref', s, s // 4)},
{stft_sql(f'b{s}', 'est', s, s // 4)},
k{s} AS (SELECT bin, m, greatest(0, least(({f} - {edge('m')}) / ({edge('m + 1')} - {edge('m')}), ({edge('m + 2')} - {f}) / ({edge('m + 2')} - {edge('m + 1')}))) * 2 / ({edge('m + 2')} - {edge('m')}) AS w FROM (SELECT unnest(range(0, {s // 2 + 1})) AS bin), (SELECT unnest(range(0, 64)) AS m)),
p{s} AS (SELECT song_id, frame, m, ln(1 + sum(w * x.mag * x.mag)) AS a, ln(1 + sum(w * y.mag * y.mag)) AS b FROM a{s} x JOIN b{s} y USING (song_id, frame, bin) JOIN k{s} USING (bin) GROUP BY ALL),
m{s} AS (SELECT song_id, avg(abs(a - b)) / (avg(abs(a)) + 1e-6) AS d FROM p{s} GROUP BY song_id)"""


QUALITY = f"{PAR}, ref AS (SELECT song_id, r[1:least(len(r), len(e))] AS y FROM par), est AS (SELECT song_id, e[1:least(len(r), len(e))] AS y FROM par), " + ",\n".join(_mel_sql(s) for s in (512, 1024, 2048))


@query("log_mel_distance", f"WITH {QUALITY} SELECT song_id, round((m512.d + m1024.d + m2048.d) / 3, 4) AS log_mel FROM m512 JOIN m1024 USING (song_id) JOIN m2048 USING (song_id)")
def log_mel_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over blocks of frames; each track is the estimate of the one before it."""
    rows = _pairs(spark, sf_dir)
    found = quality.compared(_waves(rows, "reference"), _waves(rows, "estimate"), SR, block=BLOCK)
    return found.select(F.col("target").alias("song_id"), "log_mel")


@query("fixed_segments", f"WITH {TRK}, k AS (SELECT song_id, y, unnest(range(0, greatest(len(y) - 1, 1), 88)) AS a FROM trk) SELECT song_id, CAST(a // 88 AS BIGINT) AS segment_idx, round(a / {SR}, 6) AS start_s, round(least(a + 180, len(y)) / {SR}, 6) AS end_s, round(list_sum(y[a + 1 : a + 180]), 5) AS total FROM k WHERE a = 0 OR a - 88 + 180 < len(y)")
def fixed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments.grid_segments(_waves(_tracks(spark, sf_dir), "samples"), SR, size=BLOCK)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return rows.select("song_id", "segment_idx", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), F.round(total, 5).alias("total"))


@query("usable_tracks", "WITH t AS (SELECT user_id AS song_id, count(*) AS n, max(abs(CAST(value AS FLOAT))) AS m, max(CAST(value AS FLOAT)) AS hi, min(CAST(value AS FLOAT)) AS lo FROM events GROUP BY user_id) SELECT CAST(song_id AS VARCHAR) AS song_id, n, round(least(greatest(hi / CAST(coalesce(nullif(m, 0), 1) AS DOUBLE) * CAST(0.9 AS DOUBLE), -1), 1), 5) AS high, round(least(greatest(lo / CAST(coalesce(nullif(m, 0), 1) AS DOUBLE) * CAST(0.9 AS DOUBLE), -1), 1), 5) AS low FROM t WHERE n / 4 BETWEEN 5 AND 30")
def usable_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as tracks of four values a second, of 5 to 30 seconds, normalised."""
    rows = catalog.signals(catalog.table(spark, sf_dir, "events")).groupBy("song_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("y").cast("float").alias("y")))), lambda r: r["y"]).alias("samples"))
    rows = audio.normalized(audio.usable(rows.select(F.col("song_id").cast("string").alias("song_id"), F.lit(4).alias("sr"), "samples"), 5.0, 30.0))
    return rows.select("song_id", F.size("samples").cast("long").alias("n"), F.round(F.array_max("samples").cast("double"), 5).alias("high"), F.round(F.array_min("samples").cast("double"), 5).alias("low"))


@query("pcm_round_trip", "WITH t AS (SELECT user_id AS song_id, ts, event_id, CAST(value AS DOUBLE) AS y, max(abs(CAST(value AS DOUBLE))) OVER (PARTITION BY user_id) AS m FROM events), s AS (SELECT CAST(song_id AS VARCHAR) AS song_id, row_number() OVER (PARTITION BY song_id ORDER BY ts, event_id) - 1 AS i, round_even(least(greatest(y / coalesce(nullif(m, 0), 1) * CAST(0.89 AS DOUBLE), -1), 1) * 32767, 0) / 32768 AS y FROM t) SELECT song_id, i, round(y, 6) AS y FROM s")
def pcm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as tracks, written as sound files and read again."""
    import uuid

    rows = catalog.signals(catalog.table(spark, sf_dir, "events")).groupBy("song_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda r: r["y"]).alias("samples"))
    folder = f"{shared.shared_folder(spark)}/sound-{uuid.uuid4().hex}"
    sound.write_tracks(rows.select("song_id", F.lit(4).alias("sr"), "samples"), folder)
    back = sound.read_tracks(spark, folder).select("song_id", F.posexplode("samples").alias("i", "y"))
    return back.select("song_id", F.col("i").cast("long").alias("i"), F.round("y", 6).alias("y"))


TONE_SR, TONE_N = 8000, 4000
TONES = "ton AS (SELECT CAST(vec_id AS VARCHAR) AS song_id, vec_id, CAST(44 + 3 * (vec_id % 12) AS BIGINT) AS note, CAST(10 * (vec_id % 7 - 3) AS BIGINT) AS cents, vec_id % 5 - 2 AS steps FROM embeddings)"


def _tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sine of half a second for each vector, its note and detuning by vec_id."""
    v = F.col("vec_id")
    hz = 440 * F.pow(F.lit(2.0), (44 + 3 * (v % 12) - 69 + 0.1 * (v % 7 - 3)) / 12)
    samples = F.transform(F.sequence(F.lit(0), F.lit(TONE_N - 1)), lambda i: F.sin(2 * np.pi * hz * i / TONE_SR))
    rows = catalog.table(spark, sf_dir, "embeddings").repartition(spark.sparkContext.defaultParallelism, "vec_id")
    return rows.select("vec_id", v.cast("string").alias("song_id"), F.lit(TONE_SR).alias("sr"), samples.alias("samples"))


def _note(hz: F.Column) -> F.Column:
    return F.rint(69 + 12 * F.log2(hz / 440)).cast("long")


@query("tone_pitches", f"WITH {TONES} SELECT song_id, note, cents, CASE WHEN note < 55 THEN 'bass' ELSE 'harmonic' END AS role FROM ton")
def tone_pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch (nearest note), tuning (to ten cents) and role of tones; SQL states what they were made of."""
    rows = audio.pitches(_tones(spark, sf_dir).select("song_id", "sr", "samples"))
    return rows.select("song_id", _note(F.col("hz")).alias("note"), (10 * F.rint(F.col("cents") / 10)).cast("long").alias("cents"), "role")


@query("prepared_clips", f"WITH {TONES} SELECT song_id, CAST(2000 AS BIGINT) AS n, note + steps AS note FROM ton")
def prepared_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of clips shifted by -2 to 2 semitones and played at .8, 1 or 1.25 of the pace; SQL states the notes asked for."""
    v = F.col("vec_id")
    rate = F.element_at(F.array(F.lit(0.8), F.lit(1.0), F.lit(1.25)), (v % 3 + 1).cast("int"))
    clips = audio.prepared(_tones(spark, sf_dir).select("song_id", "sr", "samples", F.lit(0.05).alias("start_s"), F.lit(2000).alias("n"), (v % 5 - 2).cast("double").alias("steps"), rate.alias("rate")))
    found = audio.pitches(clips)
    return clips.select("song_id", F.size("samples").cast("long").alias("n")).join(found, "song_id").select("song_id", "n", _note(F.col("hz")).alias("note"))


RERANK_K, WEAK = 6, 5
LONG = "lng AS (SELECT CAST(vec_id AS VARCHAR) AS song_id, flatten([v FOR k IN range(0, 4)]) AS y FROM (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings))"
RERANK = f"""{beam_sql(RERANK_K)}, {LONG}, {stft_sql('sa', 'lng', 512, 128)}, {stft_sql('sb', 'lng', 1024, 256)},
can AS (SELECT target, t, j, source_id, score FROM beam UNION ALL SELECT target, t, j + {RERANK_K}, source_id, score FROM beam),
own AS (SELECT target, t, max(score) FILTER (WHERE j = 1) AS own, max(score) FILTER (WHERE j = 2) AS nxt FROM can GROUP BY ALL),
weak AS (SELECT target, t FROM own WHERE nxt IS NOT NULL AND (own < CAST(0.985 AS DOUBLE) OR own - nxt < CAST(0.04 AS DOUBLE)) QUALIFY row_number() OVER (PARTITION BY target ORDER BY own, t) <= {WEAK}),
one AS (SELECT * FROM can JOIN weak USING (target, t) QUALIFY row_number() OVER (PARTITION BY target, t, source_id ORDER BY j) = 1),
pck AS (SELECT p.*, CAST(g.source_id AS VARCHAR) AS ref, CAST(p.source_id AS VARCHAR) AS clip FROM (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY target, t ORDER BY j) <= 3) p JOIN tgt g ON g.song_id = p.target AND g.segment_idx = p.t),
far AS (SELECT target, t, j, source_id, avg(d) AS d FROM (SELECT p.target, p.t, p.j, p.source_id, avg(abs(ln(1 + x.mag) - ln(1 + y.mag))) / (avg(abs(ln(1 + x.mag))) + 1e-9) AS d FROM pck p JOIN sa x ON x.song_id = p.ref JOIN sa y ON y.song_id = p.clip AND y.frame = x.frame AND y.bin = x.bin GROUP BY ALL
  UNION ALL SELECT p.target, p.t, p.j, p.source_id, avg(abs(ln(1 + x.mag) - ln(1 + y.mag))) / (avg(abs(ln(1 + x.mag))) + 1e-9) FROM pck p JOIN sb x ON x.song_id = p.ref JOIN sb y ON y.song_id = p.clip AND y.frame = x.frame AND y.bin = x.bin GROUP BY ALL) GROUP BY ALL),
bst AS (SELECT target, t, arg_min(source_id, (d, j)) AS best, min(d) AS low, arg_min(source_id, j) AS now, arg_min(d, j) AS high FROM far GROUP BY ALL)"""


@query("spectral_rerank", f"WITH {RERANK} SELECT target, t, CASE WHEN low <= CAST(0.96 AS DOUBLE) * high THEN best ELSE now END AS source_id FROM bst UNION ALL SELECT target, t, source_id FROM can ANTI JOIN weak USING (target, t) WHERE j = 1")
def spectral_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest in sound for the five weakest tiles of each target; every candidate comes twice, and counts once."""
    beam, t, _ = _beam(spark, sf_dir, RERANK_K)
    clip = catalog.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source_id"), F.flatten(F.array_repeat("embedding", 4)).alias("clip"))
    goal = t.select(F.col("song_id").alias("target"), F.col("segment_idx").alias("t"), "source_id").join(clip, "source_id").select("target", "t", F.col("clip").alias("reference"))
    rows = beam.select("target", "t", F.explode(F.array("j", F.col("j") + RERANK_K)).alias("j"), "source_id", "score").join(clip, "source_id").join(goal, ["target", "t"])
    return audio.reranked(rows, most=WEAK)
