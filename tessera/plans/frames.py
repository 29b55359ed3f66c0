"""Registered queries on frames: each song's vectors are its frames, of which segments, onsets and edges are described."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.costs import MatchParams, role
from ..operators import index, numbering, onsets, segments
from ..sources import catalog
from .matching import BEAM4, CONCAT, PAIRS, STEPS, _beam
from .registry import query
from .tracks import EDGES, TRK

SR, HOP = 291, 16  # four frames a hop of .22 s
WIDTHS = {"chroma": 12, "register": 3, "mfcc": 5, "contrast": 3}
FRM = "frm AS (SELECT s.song_id, s.segment_idx - 1 AS f, r.e FROM seg s JOIN raw r USING (source_id))"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(song_id, f, e): every song's vectors in order."""
    e = catalog.table(spark, sf_dir, "embeddings").where("embedding is not null")
    song = F.when(F.col("label") < 5, F.chr(F.col("label") + 65)).otherwise(F.concat(F.lit("T"), F.col("label").cast("string")))
    rows = e.select(song.alias("song_id"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return numbering.numbered(rows, ["vec_id"], ["song_id"], "f")


SEGMENTS = f"""{FRM},
len_ AS (SELECT song_id, max(f) + 1 AS n FROM frm GROUP BY song_id),
sgm AS (SELECT source_id AS segment, song_id, start_s / 4 AS start_s, start_s / 4 + CAST(0.12 AS DOUBLE) + CAST(0.05 AS DOUBLE) * (source_id % 7) AS end_s FROM seg),
rng_ AS (SELECT *, greatest(0, least(CAST(round_even(start_s * {SR}, 0) AS BIGINT) // {HOP}, n - 1)) AS f0 FROM sgm JOIN len_ USING (song_id)),
rng AS (SELECT *, greatest(f0 + 1, least(CAST(round_even(end_s * {SR}, 0) AS BIGINT) // {HOP}, n)) AS f1 FROM rng_),
hit AS (SELECT r.segment, f.e, CASE WHEN f.f - f0 < ((f1 - f0) % 4) * ((f1 - f0) // 4 + 1) THEN (f.f - f0) // ((f1 - f0) // 4 + 1) ELSE (f1 - f0) % 4 + (f.f - f0 - ((f1 - f0) % 4) * ((f1 - f0) // 4 + 1)) // greatest((f1 - f0) // 4, 1) END AS pool FROM rng r JOIN frm f ON f.song_id = r.song_id AND f.f >= f0 AND f.f < f1),
dim AS (SELECT segment, pool, unnest(range(1, 28)) AS d, unnest([abs(x) FOR x IN e[1:27]]) AS x FROM hit),
mom AS (SELECT segment, d, avg(x) AS m, stddev_pop(x) AS s FROM dim GROUP BY ALL),
pol AS (SELECT g.segment, g.b * 12 + g.d AS k, coalesce(avg(x), 0) AS v FROM (SELECT segment, b, d FROM sgm, (SELECT unnest(range(0, 4)) AS b), (SELECT unnest(range(1, 13)) AS d)) g LEFT JOIN dim d ON d.segment = g.segment AND d.pool = g.b AND d.d = g.d GROUP BY ALL),
val AS (SELECT segment, 'chroma' AS block, d AS k, m AS v FROM mom WHERE d <= 12 UNION ALL SELECT segment, 'register', d - 12, m FROM mom WHERE d BETWEEN 13 AND 15
  UNION ALL SELECT segment, 'timbre', d - 15, m FROM mom WHERE d BETWEEN 16 AND 20 UNION ALL SELECT segment, 'timbre', d - 10, s FROM mom WHERE d BETWEEN 16 AND 20 UNION ALL SELECT segment, 'timbre', d - 10, m FROM mom WHERE d BETWEEN 21 AND 23
  UNION ALL SELECT segment, 'energy', CASE d WHEN 24 THEN 1 WHEN 25 THEN 3 WHEN 26 THEN 5 ELSE 6 END, m FROM mom WHERE d >= 24 UNION ALL SELECT segment, 'energy', CASE d WHEN 24 THEN 2 ELSE 4 END, s FROM mom WHERE d IN (24, 25)
  UNION ALL SELECT segment, 'temporal', k, v FROM pol),
uni AS (SELECT segment, block, k, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY segment, block)), 1e-8) AS v FROM val
  UNION ALL SELECT segment, 'level', 1, least(greatest((20 * log10(m + 1e-8) + 60) / 60, 0), 1) FROM mom WHERE d = 24)"""


def _desc() -> str:
    from .matching import DESC

    return DESC


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment for each vector, described by the frames that it covers (within the song, at least one)."""
    rows = frames(spark, sf_dir)
    size = F.transform("e", lambda x: F.abs(x))
    part = lambda a, n: F.slice(size, a, n)
    feats = rows.select("song_id", "f", part(1, 12).alias("chroma"), part(13, 3).alias("register"), part(16, 5).alias("mfcc"), part(21, 3).alias("contrast"), *(F.abs(F.get("e", F.lit(i))).alias(c) for i, c in ((23, "rms"), (24, "centroid"), (25, "flatness"), (26, "onset"))))
    own = rows.select("song_id", F.col("vec_id").alias("segment"), (F.lit(0.22) * F.col("f") / 4).alias("start_s"))
    own = own.withColumn("end_s", F.col("start_s") + 0.12 + 0.05 * (F.col("segment") % 7))
    return segments.described(feats, own, SR, HOP, WIDTHS)


@query("segment_means", f"WITH {_desc()}, {SEGMENTS} SELECT segment, block, CAST(k AS BIGINT) AS k, round(v, 6) AS v FROM uni")
def segment_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _described(spark, sf_dir)
    blocks = ("chroma", "register", "timbre", "energy", "temporal")
    each = out.select("segment", F.inline(F.array(*[F.struct(F.lit(b).alias("block"), F.col(b).alias("v")) for b in blocks], F.struct(F.lit("level").alias("block"), F.array("level").alias("v")))))
    flat = each.select("segment", "block", F.posexplode("v").alias("k", "v"))
    return flat.select("segment", "block", (F.col("k") + 1).cast("long").alias("k"), F.round("v", 6).alias("v"))


ROLED = "pv AS (SELECT segment, max(v) FILTER (WHERE block = 'register' AND k = 1) + max(v) FILTER (WHERE block = 'register' AND k = 2) AS low, max(v) FILTER (WHERE block = 'register' AND k = 3) AS high, max(v) FILTER (WHERE block = 'energy' AND k = 5) AS flat, max(v) FILTER (WHERE block = 'energy' AND k = 6) AS onset FROM uni GROUP BY segment)"


@query("segment_roles", f"WITH {_desc()}, {SEGMENTS}, {ROLED} SELECT segment, CASE WHEN low > 0.55 AND onset < 0.45 THEN 'bass' WHEN onset > 0.55 OR (high > 0.4 AND onset > 0.35) OR flat > 0.55 THEN 'drums' WHEN low < 0.35 AND onset < 0.4 THEN 'harmonic' ELSE 'full' END AS role FROM pv")
def segment_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles by descriptors that have flatness and onset, so that every branch is met."""
    return _described(spark, sf_dir).select("segment", role("register", "energy").alias("role"))


P = onsets.PeakParams(delta=0.03)
FLUX = f"""{FRM},
flx AS (SELECT a.song_id, a.f, CASE WHEN b.f IS NULL THEN 0 ELSE round(list_sum([greatest(abs(a.e[i]) - abs(b.e[i]), 0) FOR i IN range(1, 65)]) / 64, 9) END AS s FROM frm a LEFT JOIN frm b ON b.song_id = a.song_id AND b.f = a.f - 1),
nrm_ AS (SELECT song_id, f, (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) AS x, max(f) OVER w AS last FROM flx WINDOW w AS (PARTITION BY song_id)),
pk AS (SELECT song_id, f, x = max(x) OVER (PARTITION BY song_id ORDER BY f ROWS BETWEEN {P.pre_max} PRECEDING AND CURRENT ROW) AND x >= avg(x) OVER (PARTITION BY song_id ORDER BY f ROWS BETWEEN {P.pre_avg} PRECEDING AND {P.post_avg - 1} FOLLOWING) + CAST({P.delta} AS DOUBLE) AS peak,
  f > 0 AND f < last AND x <= lag(x) OVER o AND x < lead(x) OVER o AS low FROM nrm_ WINDOW o AS (PARTITION BY song_id ORDER BY f)),
bk AS (SELECT song_id, f, peak, coalesce(max(CASE WHEN low THEN f END) OVER (PARTITION BY song_id ORDER BY f), 0) AS start FROM pk),
cn AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY f) AS i FROM bk WHERE peak),
fo AS (SELECT song_id, i, f, start, f AS kept, true AS ok FROM cn WHERE i = 1 UNION ALL SELECT c.song_id, c.i, c.f, c.start, CASE WHEN c.f > p.kept + {P.wait} THEN c.f ELSE p.kept END, c.f > p.kept + {P.wait} FROM fo p JOIN cn c ON c.song_id = p.song_id AND c.i = p.i + 1)"""


def song_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(song_id, f, start) of every song's onsets, by the rise of its vectors."""
    rows = frames(spark, sf_dir).select("song_id", "f", F.transform("e", lambda x: F.abs(x)).alias("e"))
    return onsets.onsets(onsets.flux(rows, "e"), P)


@query("target_onsets", f"WITH RECURSIVE {_desc()}, {FLUX} SELECT song_id, f, CAST(start AS BIGINT) AS start FROM fo WHERE ok")
def target_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return song_onsets(spark, sf_dir)


VEC = "trk AS (SELECT vec_id AS song_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS y FROM embeddings)"
EDGED = EDGES.replace(TRK, VEC)
_JOIN = "CASE WHEN x.source_id = y.source_id THEN 0 ELSE CAST(0.7 AS DOUBLE) * greatest(0, 1 - list_inner_product(ea.v, eb.v)) END"
JOINED_STEPS = (
    STEPS.replace("CAST(0.55 AS DOUBLE) * c.concat ELSE", f"CAST(0.55 AS DOUBLE) * c.concat + CAST(0.1 AS DOUBLE) * {_JOIN} ELSE")
    .replace("* c.concat\n  ELSE CAST(0.55 AS DOUBLE) * c.concat", f"* c.concat + CAST(0.1 AS DOUBLE) * {_JOIN}\n  ELSE CAST(0.55 AS DOUBLE) * c.concat + {_JOIN}")
    .replace("AND c.b = y.source_id)", "AND c.b = y.source_id JOIN unt ea ON ea.id = x.source_id AND ea.side = 'tail' JOIN unt eb ON eb.id = y.source_id AND eb.side = 'head')")
)
UNT = ", unt AS (SELECT song_id AS id, side, [x / (sqrt(list_inner_product(e, e)) + 1e-8) FOR x IN e] AS v FROM edg)"


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    beam, t, s = _beam(spark, sf_dir)
    clips = catalog.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source_id"), F.col("embedding").alias("samples"))
    return beam, t, index.built(s, clips, 400)


@query("source_index", f"WITH {_desc()}, {EDGED}{UNT}, u AS (SELECT id AS source_id, side, unnest(range(0, 15)) AS k, unnest(v) AS x FROM unt WHERE id IN (SELECT source_id FROM src)) SELECT source_id, k, round(max(x) FILTER (WHERE side = 'head'), 6) AS head, round(max(x) FILTER (WHERE side = 'tail'), 6) AS tail FROM u GROUP BY ALL")
def source_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _index(spark, sf_dir)[2].select("source_id", F.posexplode(F.arrays_zip("head", "tail")).alias("k", "x"))
    return rows.select("source_id", F.col("k").cast("long").alias("k"), F.round("x.head", 6).alias("head"), F.round("x.tail", 6).alias("tail"))


@query("edge_transition_cost", f"WITH {BEAM4}{PAIRS}{CONCAT}, {EDGED}{UNT}{JOINED_STEPS} SELECT target, t, i, j, a, b, round(cost, 6) AS cost FROM stp")
def edge_transition_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step costs with the fingerprints of both edges, read from the stored index."""
    from ..operators import decode

    beam, t, s = _index(spark, sf_dir)
    return decode.step_costs(beam, t, s, MatchParams(top_k=4)).withColumn("cost", F.round("cost", 6))
