"""Registered queries on descriptors: search, costs, paths, shares, runs, layers, factorisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.costs import MatchParams, fold_shift, pitch_delta, pitch_steps, residual_fill, role
from ..functions.vectors import dot, rotate, shares, unit
from ..functions.arrays import brightness, clock_hundredths, fit_length, frame_of, window_at
from ..operators import decode, factorize, measures, mosaic, numbering, search
from ..sources import catalog, documents, shared
from .registry import query

DESC = """
raw AS (SELECT vec_id AS source_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
blk AS (SELECT source_id, label, [abs(x) FOR x IN e[1:48]] AS t0, [(abs(e[i]) + abs(e[i+12]) + abs(e[i+24]) + abs(e[i+36])) / 4 FOR i IN range(1, 13)] AS c0,
  e[49:56] AS m0, [abs(x) FOR x IN e[57:60]] AS g0, [abs(x) FOR x IN e[61:63]] AS r0, least(1.0, 4 * abs(e[64])) AS level FROM raw),
nrm AS (SELECT *, greatest(sqrt(list_sum([x*x FOR x IN t0])), 1e-8) AS tn, greatest(sqrt(list_sum([x*x FOR x IN c0])), 1e-8) AS cn, greatest(sqrt(list_sum([x*x FOR x IN m0])), 1e-8) AS mn,
  greatest(sqrt(list_sum([x*x FOR x IN g0])), 1e-8) AS gn, greatest(sqrt(list_sum([x*x FOR x IN r0])), 1e-8) AS rn FROM blk),
descr AS (SELECT source_id, label, CASE WHEN label < 5 THEN chr(CAST(65 + label AS INTEGER)) ELSE 'T' || CAST(label AS VARCHAR) END AS song_id,
  CAST(row_number() OVER (PARTITION BY label ORDER BY source_id) AS BIGINT) AS segment_idx,
  [x / cn FOR x IN c0] AS chroma, [x / tn FOR x IN t0] AS temporal, [x / mn FOR x IN m0] AS timbre, [x / gn FOR x IN g0] AS energy, [x / rn FOR x IN r0] AS register, level FROM nrm),
seg AS (SELECT *, CAST(0.22 AS DOUBLE) * (segment_idx - 1) AS start_s, CAST(0.22 AS DOUBLE) * (segment_idx - 1) + CAST(0.12 AS DOUBLE) + CAST(0.05 AS DOUBLE) * (source_id % 7) AS end_s FROM descr),
src AS (SELECT * FROM seg WHERE label < 5),
tgt AS (SELECT * FROM seg WHERE label >= 5)"""

SCORE = (
    DESC
    + """,
rot AS (SELECT s.source_id, s.song_id, k.k AS shift, [s.chroma[1 + ((i + 12 - k.k) % 12)] FOR i IN range(0, 12)] AS c, [s.temporal[1 + (i // 12) * 12 + ((i % 12 + 12 - k.k) % 12)] FOR i IN range(0, 48)] AS tt FROM src s, (SELECT unnest(range(0, 12)) AS k) k),
har AS (SELECT t.song_id AS target, t.segment_idx AS t, r.source_id, r.shift, round(CAST(0.68 AS DOUBLE) * list_inner_product(t.chroma, r.c) + CAST(0.32 AS DOUBLE) * list_inner_product(t.temporal, r.tt), 9) AS h FROM tgt t, rot r),
top AS (SELECT target, t, source_id, max(h) AS h, min(shift) FILTER (WHERE h = m) AS shift FROM (SELECT *, max(h) OVER (PARTITION BY target, t, source_id) AS m FROM har) GROUP BY ALL),
score AS (SELECT p.target, p.t, p.source_id, s.song_id, CAST(p.shift AS INTEGER) AS key_shift, round(CAST(0.86 AS DOUBLE) * (CAST(0.42 AS DOUBLE) * p.h + CAST(0.40 AS DOUBLE) * list_inner_product(t.timbre, s.timbre)
  + CAST(0.18 AS DOUBLE) * (CAST(0.72 AS DOUBLE) * list_inner_product(t.energy, s.energy) + CAST(0.28 AS DOUBLE) * least(greatest(1 - abs(t.level - s.level), 0), 1))) + CAST(0.14 AS DOUBLE) * list_inner_product(t.register, s.register), 6) AS score
  FROM top p JOIN src s USING (source_id) JOIN tgt t ON t.song_id = p.target AND t.segment_idx = p.t)"""
)

def beam_sql(k: int) -> str:
    return SCORE + f",\nbeam AS (SELECT *, CAST(row_number() OVER (PARTITION BY target, t ORDER BY score DESC, source_id) AS BIGINT) AS j FROM score QUALIFY j <= {k})"


K = 4
P = MatchParams(top_k=K)


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = catalog.table(spark, sf_dir, "embeddings")
    return catalog.targets(e), catalog.sources(e)


def _beam(spark: SparkSession, sf_dir: str, k: int = K) -> tuple[DataFrame, DataFrame, DataFrame]:
    t, s = _sides(spark, sf_dir)
    return shared.written(search.beam_topk(t, s, k), "beam"), t, s


@query("descriptor_blocks", f"WITH {DESC} SELECT source_id, song_id, segment_idx, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, round(list_sum(chroma), 6) AS chroma, round(list_sum(temporal), 6) AS temporal, round(list_sum(timbre), 6) AS timbre, round(list_sum(energy), 6) AS energy, round(list_sum(register), 6) AS register, round(level, 6) AS level FROM seg")
def descriptor_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.vectors import total

    d = catalog.descriptors(catalog.table(spark, sf_dir, "embeddings"))
    blocks = [F.round(total(F.col(c)), 6).alias(c) for c in ("chroma", "temporal", "timbre", "energy", "register")]
    return d.select("source_id", "song_id", "segment_idx", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), *blocks, F.round("level", 6).alias("level"))


BEAM_COLS = "target, t, j, source_id, song_id, score, key_shift"


@query("beam_topk", f"WITH {beam_sql(10)} SELECT {BEAM_COLS} FROM beam")
def beam_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _beam(spark, sf_dir, 10)[0].select(*BEAM_COLS.split(", "))


@query(
    "beam_diverse",
    f"""WITH {SCORE},
own AS (SELECT *, row_number() OVER (PARTITION BY target, t, song_id ORDER BY score DESC, source_id) AS r FROM score QUALIFY r <= 2),
rest AS (SELECT *, row_number() OVER (PARTITION BY target, t ORDER BY score DESC, source_id) AS r FROM score ANTI JOIN own USING (target, t, source_id)),
have AS (SELECT target, t, count(*) AS n FROM own GROUP BY ALL),
picks AS (SELECT target, t, source_id, song_id, score, key_shift FROM own UNION ALL SELECT target, t, source_id, song_id, score, key_shift FROM rest JOIN have USING (target, t) WHERE r <= 12 - n)
SELECT target, t, CAST(row_number() OVER (PARTITION BY target, t ORDER BY score DESC, source_id DESC) AS BIGINT) AS j, source_id, song_id, score, key_shift FROM picks QUALIFY j <= 12""",
)
def beam_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = _sides(spark, sf_dir)
    return search.beam_diverse(t, s, 12, 2).select(*BEAM_COLS.split(", "))


# the weights of other descriptor backends
OTHER = SCORE.replace("CAST(0.42 AS DOUBLE) * p.h", "CAST(0.48 AS DOUBLE) * p.h").replace("CAST(0.40 AS DOUBLE) * list_inner_product(t.timbre", "CAST(0.32 AS DOUBLE) * list_inner_product(t.timbre").replace("CAST(0.18 AS DOUBLE) * (CAST(0.72", "CAST(0.20 AS DOUBLE) * (CAST(0.72")


@query("beam_other_backend", f"WITH {OTHER}, beam AS (SELECT *, CAST(row_number() OVER (PARTITION BY target, t ORDER BY score DESC, source_id) AS BIGINT) AS j FROM score QUALIFY j <= 10) SELECT {BEAM_COLS} FROM beam")
def beam_other_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = _sides(spark, sf_dir)
    return search.beam_topk(t, s, 10, search.Weights.of("other")).select(*BEAM_COLS.split(", "))


@query("key_shift_hist", f"WITH {beam_sql(10)} SELECT target, key_shift, CAST(count(*) AS BIGINT) AS n FROM beam GROUP BY ALL")
def key_shift_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _beam(spark, sf_dir, 10)[0].groupBy("target", "key_shift").agg(F.count("*").alias("n"))


@query("rotations", f"WITH {DESC} SELECT source_id, CAST(k AS INTEGER) AS shift, CAST(1 + list_position([round(chroma[1 + ((i + 12 - k) % 12)], 9) FOR i IN range(0, 12)], list_max([round(x, 9) FOR x IN chroma])) - 1 AS BIGINT) AS peak FROM src, (SELECT unnest(range(0, 12)) AS k)")
def rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s = _sides(spark, sf_dir)
    peaks = [F.struct(F.lit(k).alias("shift"), F.array_position(F.transform(rotate("chroma", k), lambda x: F.round(x, 9)), F.round(F.array_max("chroma"), 9)).alias("peak")) for k in range(12)]
    return s.select("source_id", F.inline(F.array(*peaks)))


@query("unit_shares", f"WITH {DESC} SELECT source_id, round(list_sum([x * x FOR x IN chroma]), 6) AS square, round(list_max(chroma) / greatest(list_sum(chroma), 1e-8), 6) AS top_share FROM seg")
def unit_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = catalog.descriptors(catalog.table(spark, sf_dir, "embeddings"))
    u = unit("chroma")
    return d.select("source_id", F.round(dot(u, u), 6).alias("square"), F.round(F.array_max(shares(F.col("chroma"))), 6).alias("top_share"))


PAIRS = ",\npairs AS (SELECT DISTINCT x.target, x.source_id AS a, y.source_id AS b FROM beam x JOIN beam y ON x.target = y.target AND y.t = x.t + 1)"
CONCAT = ",\nconc AS (SELECT DISTINCT p.a, p.b, 1 - (CAST(0.4 AS DOUBLE) * list_inner_product(x.chroma, y.chroma) + CAST(0.4 AS DOUBLE) * list_inner_product(x.timbre, y.timbre) + CAST(0.2 AS DOUBLE) * list_inner_product(x.energy, y.energy)) AS concat, x.song_id AS a_song, y.song_id AS b_song, x.start_s AS a_start, y.start_s AS b_start FROM pairs p JOIN src x ON x.source_id = p.a JOIN src y ON y.source_id = p.b)"
LOCAL = ",\nloc AS (SELECT b.*, 1 - b.score + CAST(0.12 AS DOUBLE) * least(abs(ln(greatest(s.end_s - s.start_s, 0.02) / greatest(t.end_s - t.start_s, 0.02))), 1.5) AS local FROM beam b JOIN src s USING (source_id) JOIN tgt t ON t.song_id = b.target AND t.segment_idx = b.t)"
STEPS = """,
ord AS (SELECT song_id AS target, segment_idx AS t, start_s - lag(start_s) OVER (PARTITION BY song_id ORDER BY segment_idx) AS step FROM tgt),
stp AS (SELECT y.target, y.t, x.j AS i, y.j, x.source_id AS a, y.source_id AS b,
  CASE WHEN c.a_song = c.b_song AND abs(c.a_start + o.step - c.b_start) < greatest(0.06, o.step * CAST(0.55 AS DOUBLE)) THEN CAST(-0.28 AS DOUBLE) + CAST(0.1 AS DOUBLE) * CAST(0.55 AS DOUBLE) * c.concat
  ELSE CAST(0.55 AS DOUBLE) * c.concat + CASE WHEN c.a_song = c.b_song THEN CAST(0.15 AS DOUBLE) * least(1.0, abs(c.a_start + o.step - c.b_start) / 2) ELSE CAST(0.08 AS DOUBLE) END + CASE WHEN x.source_id = y.source_id THEN CAST(0.03 AS DOUBLE) ELSE 0 END END
  + CAST(0.06 AS DOUBLE) * least(6, abs(x.key_shift - y.key_shift)) AS cost
  FROM beam x JOIN beam y ON x.target = y.target AND y.t = x.t + 1 JOIN ord o ON o.target = y.target AND o.t = y.t JOIN conc c ON c.a = x.source_id AND c.b = y.source_id)"""
VITERBI = """,
dp AS (SELECT target, t, j, round(local, 9) AS cost, [j] AS path FROM loc WHERE t = 1
  UNION ALL
  SELECT target, t, j, round(arg_min(c, (c, i)) + any_value(local), 9), list_append(arg_min(path, (c, i)), j) FROM (
    SELECT s.target, s.t, s.j, s.i, round(d.cost + s.cost, 9) AS c, d.path, l.local FROM dp d JOIN stp s ON s.target = d.target AND s.t = d.t + 1 AND s.i = d.j JOIN loc l ON l.target = s.target AND l.t = s.t AND l.j = s.j) GROUP BY target, t, j)"""
BEAM4 = beam_sql(K)
PATH_SQL = f"{BEAM4}{PAIRS}{CONCAT}{LOCAL}{STEPS}{VITERBI},\nlast AS (SELECT target, arg_min(path, (cost, j)) AS path FROM dp WHERE (target, t) IN (SELECT (song_id, max(segment_idx)) FROM tgt GROUP BY song_id) GROUP BY target),\npth AS (SELECT target, unnest(range(1, len(path) + 1)) AS t, unnest(path) AS j FROM last),\ntil AS (SELECT b.* FROM pth p JOIN beam b ON b.target = p.target AND b.t = p.t AND b.j = p.j)"


@query("adjacent_pairs", f"WITH {BEAM4}{PAIRS} SELECT target, a, b FROM pairs")
def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.adjacent_pairs(_beam(spark, sf_dir)[0])


@query("concat_cost", f"WITH {BEAM4}{PAIRS}{CONCAT} SELECT a, b, round(concat, 6) + 0 AS concat FROM conc")
def concat_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    beam, _, s = _beam(spark, sf_dir)
    return decode.concat_costs(decode.adjacent_pairs(beam).select("a", "b").distinct(), s).select("a", "b", (F.round("concat", 6) + 0.0).alias("concat"))


@query("duration_cost", f"WITH {BEAM4}{LOCAL} SELECT target, t, j, round(local, 6) AS local, round(local - 1 + score, 6) AS duration FROM loc")
def duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    beam, t, s = _beam(spark, sf_dir)
    return decode.local_costs(beam, t, s, P).select("target", "t", "j", F.round("local", 6).alias("local"), F.round(F.col("local") - 1 + F.col("score"), 6).alias("duration"))


@query("transition_cost", f"WITH {BEAM4}{PAIRS}{CONCAT}{STEPS} SELECT target, t, i, j, a, b, round(cost, 6) AS cost FROM stp")
def transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    beam, t, s = _beam(spark, sf_dir)
    return decode.step_costs(beam, t, s, P).withColumn("cost", F.round("cost", 6))


def _path(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    beam, t, s = _beam(spark, sf_dir)
    local = decode.local_costs(beam, t, s, P).select("target", "t", "j", "local")
    return decode.cheapest_path(local, decode.step_costs(beam, t, s, P)), beam, t, s


def _tiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    path, beam, t, s = _path(spark, sf_dir)
    return path.drop("cost").join(beam, ["target", "t", "j"]), beam, t, s


@query("viterbi_cost", f"WITH RECURSIVE {BEAM4}{PAIRS}{CONCAT}{LOCAL}{STEPS}{VITERBI} SELECT target, round(min(cost), 6) AS cost FROM dp WHERE (target, t) IN (SELECT (song_id, max(segment_idx)) FROM tgt GROUP BY song_id) GROUP BY target")
def viterbi_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, sf_dir)[0]
    return path.groupBy("target").agg(F.round(F.max_by("cost", "t"), 6).alias("cost"))


@query("viterbi_path", f"WITH RECURSIVE {PATH_SQL} SELECT target, t, j, source_id, song_id FROM til")
def viterbi_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir)[0].select("target", "t", "j", "source_id", "song_id")


@query("greedy_transitions", f"WITH {BEAM4} SELECT target, CAST(sum(c) AS BIGINT) AS transitions FROM (SELECT target, CASE WHEN song_id <> lag(song_id) OVER (PARTITION BY target ORDER BY t) THEN 1 ELSE 0 END AS c FROM beam WHERE j = 1) GROUP BY target")
def greedy_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.transitions(_beam(spark, sf_dir)[0].where("j = 1"))


@query("path_summary", f"WITH RECURSIVE {PATH_SQL} SELECT target, CAST(sum(c) AS BIGINT) AS transitions, round(avg(score), 6) AS similarity FROM (SELECT target, score, CASE WHEN song_id <> lag(song_id) OVER (PARTITION BY target ORDER BY t) THEN 1 ELSE 0 END AS c FROM til) GROUP BY target")
def path_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = _tiles(spark, sf_dir)[0]
    mean = tiles.groupBy("target").agg(F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("similarity"))
    return decode.transitions(tiles).join(mean, "target")


@query("song_shares", f"WITH {BEAM4} SELECT target, song_id, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY target), 6) AS share FROM beam WHERE j = 1 GROUP BY target, song_id")
def song_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.song_shares(_beam(spark, sf_dir)[0].where("j = 1")).withColumn("share", F.round("share", 6))


RUNS_SQL = ",\nchg AS (SELECT target, t, song_id, CASE WHEN song_id <> lag(song_id) OVER (PARTITION BY target ORDER BY t) THEN 1 WHEN lag(song_id) OVER (PARTITION BY target ORDER BY t) IS NULL THEN 1 ELSE 0 END AS n FROM beam WHERE j = 1),\nnum AS (SELECT *, CAST(sum(n) OVER (PARTITION BY target ORDER BY t) AS BIGINT) AS run FROM chg),\nrun AS (SELECT target, run, min(song_id) AS song_id, min(t) AS first, max(t) AS last, CAST(count(*) AS BIGINT) AS length FROM num GROUP BY target, run)"


@query("runs", f"WITH {BEAM4}{RUNS_SQL} SELECT * FROM run")
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.runs(_beam(spark, sf_dir)[0].where("j = 1"))


@query(
    "short_runs",
    f"WITH {BEAM4}{RUNS_SQL}, side AS (SELECT *, lag(length) OVER w AS ll, lag(song_id) OVER w AS ls, lead(length) OVER w AS rl, lead(song_id) OVER w AS rs FROM run WINDOW w AS (PARTITION BY target ORDER BY run)) "
    "SELECT target, run, song_id, length, CASE WHEN rl IS NOT NULL AND (ll IS NULL OR rl > ll) THEN rs ELSE ls END AS taken_by FROM side WHERE length < 3",
)
def short_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.absorbing_songs(decode.runs(_beam(spark, sf_dir)[0].where("j = 1")), 3)


@query("nearest_clip", f"WITH {BEAM4}, want AS (SELECT target, t, song_id, t * CAST(0.31 AS DOUBLE) AS want FROM beam WHERE j = 1) SELECT w.target, w.t, w.song_id, arg_min(s.source_id, (round(abs(s.start_s - w.want), 9), s.start_s, s.source_id)) AS source_id FROM want w JOIN src s USING (song_id) GROUP BY ALL")
def nearest_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    beam, _, s = _beam(spark, sf_dir)
    want = beam.where("j = 1").select("target", "t", "song_id", (F.col("t") * 0.31).alias("want"))
    return decode.nearest_clip(want, s).select("target", "t", "song_id", "source_id")


ROLE_SQL = "CASE WHEN register[1] + register[2] > 0.55 THEN 'bass' WHEN register[1] + register[2] < 0.35 THEN 'harmonic' ELSE 'full' END"


@query("roles", f"WITH {DESC} SELECT source_id, {ROLE_SQL} AS role FROM src")
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir)[1].select("source_id", role("register", "energy").alias("role"))


LAYER_P = MatchParams(top_k=12, n_layers=3)
LAYER_SQL = f"""{beam_sql(12)},
rol AS (SELECT source_id, chroma, timbre, {ROLE_SQL} AS role FROM src),
main AS (SELECT b.target, b.t, b.source_id AS main_id, b.song_id AS main_song, b.score AS main_score, r.chroma AS mc, r.timbre AS mt, r.role AS mr, g.chroma AS goal FROM beam b JOIN rol r USING (source_id) JOIN tgt g ON g.song_id = b.target AND g.segment_idx = b.t WHERE b.j = 1),
can AS (SELECT b.*, m.*, r.chroma, r.timbre, r.role, [greatest(0.0, m.goal[i] - m.mc[i]) FOR i IN range(1, 13)] AS miss FROM beam b JOIN main m ON m.target = b.target AND m.t = b.t JOIN rol r USING (source_id) WHERE b.song_id <> m.main_song AND b.score >= greatest(0.22, m.main_score * CAST(0.82 AS DOUBLE))),
cmp AS (SELECT target, t, source_id, song_id, score, round(CAST(0.5 AS DOUBLE) * greatest(0.0, score) + CAST(0.18 AS DOUBLE) * (1 - least(greatest(list_inner_product(mt, timbre), 0), 1)) + CAST(0.22 AS DOUBLE) * CASE WHEN sqrt(list_sum([x * x FOR x IN miss])) < 1e-6 THEN 0 ELSE list_inner_product(miss, chroma) / sqrt(list_sum([x * x FOR x IN miss])) END
  + CASE WHEN mr = 'bass' AND role = 'bass' THEN CAST(-0.25 AS DOUBLE) WHEN mr = 'drums' AND role = 'drums' THEN CAST(-0.12 AS DOUBLE) WHEN role <> mr AND role <> 'full' THEN CAST(0.18 AS DOUBLE) ELSE 0 END, 6) AS comp FROM can),
bst AS (SELECT * FROM cmp QUALIFY row_number() OVER (PARTITION BY target, t, song_id ORDER BY comp DESC, source_id DESC) = 1),
rnk AS (SELECT *, CAST(row_number() OVER (PARTITION BY target, t ORDER BY comp DESC, source_id DESC) AS BIGINT) AS layer FROM bst QUALIFY layer < 3),
exs AS (SELECT *, exp((greatest(score, 1e-3) - max(greatest(score, 1e-3)) OVER (PARTITION BY target, t)) / CAST(0.28 AS DOUBLE)) AS e FROM rnk),
lay AS (SELECT target, t, layer, source_id, song_id, CAST(0.38 AS DOUBLE) * e / sum(e) OVER (PARTITION BY target, t) AS weight FROM exs
  UNION ALL SELECT target, t, 0, source_id, song_id, CASE WHEN (target, t) IN (SELECT (target, t) FROM exs) THEN CAST(0.62 AS DOUBLE) ELSE 1 END FROM beam WHERE j = 1)"""


def _layers(spark: SparkSession, sf_dir: str, beam: DataFrame | None = None) -> DataFrame:
    """Of a beam of 12, found if not given."""
    t, s = _sides(spark, sf_dir)
    beam = _beam(spark, sf_dir, 12)[0] if beam is None else beam
    return decode.layers(beam.where("j = 1"), beam, t, s, LAYER_P)


@query("layer_weights", f"WITH {LAYER_SQL} SELECT target, t, layer, source_id, song_id, round(weight, 6) AS weight FROM lay")
def layer_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layers(spark, sf_dir).withColumn("weight", F.round("weight", 6))


@query("contribution_pct", f"WITH {LAYER_SQL}, sm AS (SELECT target, song_id, sum(weight) AS w FROM lay GROUP BY ALL), grid AS (SELECT DISTINCT target, s AS song_id FROM lay, (SELECT unnest(['A','B','C','D','E']) AS s)) SELECT g.target, g.song_id, round(coalesce(w / sum(w) OVER (PARTITION BY g.target), 0) * 100, 1) AS pct FROM grid g LEFT JOIN sm USING (target, song_id)")
def contribution_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.contributions(_layers(spark, sf_dir), catalog.SOURCES)


@query("residual_fill", f"WITH {DESC}, p AS (SELECT t.song_id AS target, t.segment_idx AS t, a.song_id AS a, b.song_id AS b, [greatest(0.0, t.chroma[i] - a.chroma[i]) FOR i IN range(1, 13)] AS miss, b.chroma FROM tgt t JOIN src a ON a.segment_idx = t.segment_idx JOIN src b ON b.song_id > a.song_id AND b.segment_idx = t.segment_idx) SELECT target, t, a, b, round(CASE WHEN sqrt(list_sum([x * x FOR x IN miss])) < 1e-6 THEN 0 ELSE list_inner_product(miss, chroma) / sqrt(list_sum([x * x FOR x IN miss])) END, 6) AS fill FROM p")
def residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = _sides(spark, sf_dir)
    a = s.select("segment_idx", F.col("song_id").alias("a"), F.col("chroma").alias("first"))
    b = s.select("segment_idx", F.col("song_id").alias("b"), F.col("chroma").alias("second"))
    rows = t.join(a, "segment_idx").join(b, "segment_idx").where("b > a")
    return rows.select(F.col("song_id").alias("target"), F.col("segment_idx").alias("t"), "a", "b", F.round(residual_fill("chroma", "first", "second"), 6).alias("fill"))


@query("shift_policy", f"WITH {BEAM4}, s AS (SELECT target, t, j, key_shift * 3 - 12 AS s FROM beam), f AS (SELECT *, s - 12 * CASE WHEN s > 6 THEN ceil((s - 6) / 12) WHEN s < -6 THEN -ceil((-6 - s) / 12) ELSE 0 END AS f FROM s) SELECT target, t, j, CAST(f AS DOUBLE) AS folded, CASE WHEN abs(f) >= 1.5 THEN CAST(0 AS DOUBLE) ELSE CAST(least(greatest(f, CAST(-0.35 AS DOUBLE)), CAST(0.35 AS DOUBLE)) AS DOUBLE) END AS drums FROM f")
def shift_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("key_shift").cast("double") * 3 - 12
    return _beam(spark, sf_dir)[0].select("target", "t", "j", fold_shift(s, F.lit("full")).alias("folded"), fold_shift(s, F.lit("drums")).alias("drums"))


@query(
    "pitch_policy",
    f"WITH {DESC}, h AS (SELECT source_id, 110 + source_id % 400 AS a, 40 + (source_id * 7) % 1900 AS b, source_id % 12 AS k, source_id % 5 AS c FROM src), d AS (SELECT *, 12 * log2(b / a) AS d FROM h), "
    "f AS (SELECT *, CASE WHEN abs(d) > 14 THEN d - 12 * CASE WHEN d > 6 THEN ceil((d - 6) / 12) WHEN d < -6 THEN -ceil((-6 - d) / 12) ELSE 0 END ELSE d END AS f FROM d) "
    "SELECT source_id, round(CASE WHEN abs(d) > 14 AND abs(f) > 8 THEN NULL ELSE f END, 6) AS delta, round(least(greatest(d, -12), 12), 6) AS steps, round((CASE WHEN k > 6 THEN k - 12 ELSE k END) + CASE WHEN c > 0.5 THEN c / 100 ELSE 0 END, 6) AS by_key FROM f",
)
def pitch_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sides(spark, sf_dir)[1]
    i = F.col("source_id")
    a, b, k, c = (110 + i % 400).cast("double"), (40 + (i * 7) % 1900).cast("double"), (i % 12).cast("double"), (i % 5).cast("double")
    none = F.lit(None).cast("double")
    return s.select("source_id", F.round(pitch_delta(a, b), 6).alias("delta"), F.round(pitch_steps(F.lit("full"), k, c, a, b), 6).alias("steps"), F.round(pitch_steps(F.lit("full"), k, c, none, none), 6).alias("by_key"))


KNN = ",\nknn AS (SELECT *, CAST(row_number() OVER (PARTITION BY target, t, song_id ORDER BY score DESC, source_id) AS BIGINT) AS r FROM score QUALIFY r <= 2)"
ACT = KNN + ",\nact AS (SELECT k.target, k.t, k.source_id, k.song_id, s.segment_idx AS frame, k.score AS h FROM knn k JOIN src s USING (source_id))"


def _knn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t, s = _sides(spark, sf_dir)
    return shared.written(factorize.nearest_per_song(search.scored(t, s, 2, True), 2), "nearest"), t, s


def _act(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    knn, t, s = _knn(spark, sf_dir)
    return knn.join(s.select("source_id", F.col("segment_idx").alias("frame")), "source_id").select("target", "t", "source_id", "song_id", "frame", F.col("score").alias("h")), t, s


@query("nmf_knn_per_song", f"WITH {SCORE}{KNN} SELECT target, t, song_id, r, source_id, score FROM knn")
def nmf_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir)[0].select("target", "t", "song_id", "r", "source_id", "score")


@query("diag_continuity", f"WITH {SCORE}{ACT} SELECT a.target, a.t, a.source_id, round(a.h + CAST(0.35 AS DOUBLE) * coalesce(max(b.h), 0), 9) AS h FROM act a LEFT JOIN act b ON b.target = a.target AND b.t = a.t - 1 AND b.song_id = a.song_id AND b.frame = a.frame - 1 GROUP BY a.target, a.t, a.source_id, a.h")
def diag_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorize.diagonal_continuity(_act(spark, sf_dir)[0], 0.35).select("target", "t", "source_id", F.round("h", 9).alias("h"))


def _changes(t: DataFrame, radius: int) -> DataFrame:
    s = t.select(F.col("song_id").alias("target"), F.col("segment_idx").alias("t"), shares(F.col("chroma")).alias("v"))
    out = None
    for lag in range(1, radius + 1):
        pair = s.join(s.select("target", (F.col("t") + lag).alias("t"), F.col("v").alias("w")), ["target", "t"])
        change = F.aggregate(F.zip_with("v", "w", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: a + x)
        pair = pair.select("target", "t", F.lit(lag).alias("lag"), change.alias("change"))
        out = pair if out is None else out.unionByName(pair)
    return out


def _suppressed_sql(lag: int) -> str:
    """Table rp{lag} from rp{lag - 1}: one lag of repetition."""
    return f"""cg{lag} AS (SELECT x.target, x.t, list_sum([abs(x.v[i] - y.v[i]) FOR i IN range(1, 13)]) AS c FROM shp x JOIN shp y ON y.target = x.target AND y.t = x.t - {lag}),
rp{lag} AS (SELECT a.target, a.t, a.source_id, CASE WHEN c.c > 0.08 AND coalesce(max(b.h), 0) >= a.h THEN a.h * CAST(0.18 AS DOUBLE) ELSE a.h END AS h FROM rp{lag - 1} a LEFT JOIN rp{lag - 1} b ON b.target = a.target AND b.t = a.t - {lag} AND b.source_id = a.source_id LEFT JOIN cg{lag} c ON c.target = a.target AND c.t = a.t GROUP BY a.target, a.t, a.source_id, a.h, c.c)"""


@query("repetition_suppress", f"WITH {SCORE}{ACT}, shp AS (SELECT song_id AS target, segment_idx AS t, [x / greatest(list_sum(chroma), 1e-8) FOR x IN chroma] AS v FROM tgt), rp0 AS (SELECT target, t, source_id, h FROM act), {', '.join(_suppressed_sql(lag) for lag in (1, 2, 3))} SELECT target, t, source_id, round(h, 9) AS h FROM rp3")
def repetition_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    act, t, _ = _act(spark, sf_dir)
    return factorize.suppress_repetition(act, _changes(t, 3), 3, 0.18).select("target", "t", "source_id", F.round("h", 9).alias("h"))


POLY = ",\nown AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY target, t, song_id ORDER BY h DESC, source_id) = 1 THEN h ELSE 0 END AS v FROM act),\npol AS (SELECT target, t, source_id, song_id, CASE WHEN row_number() OVER (PARTITION BY target, t ORDER BY v DESC, source_id) <= 3 THEN v ELSE 0 END AS h FROM own)"


@query("polyphony_limit", f"WITH {SCORE}{ACT}{POLY} SELECT target, t, source_id, h FROM pol")
def polyphony_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorize.limit_polyphony(_act(spark, sf_dir)[0], 3).select("target", "t", "source_id", "h")


@query("nmf_contribution", f"WITH {SCORE}{ACT}{POLY}, cnt AS (SELECT target, avg(n) AS polyphony FROM (SELECT target, t, count(*) FILTER (WHERE h > 1e-4) AS n FROM pol GROUP BY ALL) GROUP BY target) SELECT target, song_id, round(100 * sum(h) / greatest(sum(sum(h)) OVER (PARTITION BY target), 1e-8), 1) AS pct, round(any_value(polyphony), 6) AS polyphony FROM pol JOIN cnt USING (target) GROUP BY target, song_id")
def nmf_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorize.contributions(factorize.limit_polyphony(_act(spark, sf_dir)[0], 3)).withColumn("polyphony", F.round("polyphony", 6))


@query("polyphony_p65", f"WITH {DESC}, a AS (SELECT song_id AS target, len([x FOR x IN chroma IF x >= greatest(1e-6, list_max(chroma) * CAST(0.32 AS DOUBLE))]) AS n FROM tgt WHERE list_max(chroma) > 1e-6) SELECT target, CAST(least(greatest(round_even(quantile_cont(n, 0.65), 0), 1), 8) AS BIGINT) AS polyphony FROM a GROUP BY target")
def polyphony_p65(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorize.estimated_polyphony(_sides(spark, sf_dir)[0].select(F.col("song_id").alias("target"), "chroma"), 8)


@query("nmf_learn")
def nmf_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activations after eight updates; a fold over each target, checked in the tests against plain loops."""
    t, s = _sides(spark, sf_dir)
    beam = search.beam_topk(t, s, 8)
    atoms = s.select("source_id", F.col("segment_idx").alias("frame"), shares(F.col("chroma")).alias("shape"))
    goal = t.select(F.col("song_id").alias("target"), F.col("segment_idx").alias("t"), shares(F.col("chroma")).alias("goal"))
    rows = beam.join(atoms, "source_id").join(goal, ["target", "t"]).select("target", "t", F.col("j").alias("slot"), "source_id", "song_id", "frame", "shape", "goal")
    return factorize.learn(rows).withColumns({"h": F.round("h", 6), "error": F.round("error", 6)})


@query("balanced_shares")
def balanced_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares after decoding with a cost on over-used songs; iterative, checked in the tests by behaviour."""
    beam, t, s = _beam(spark, sf_dir, 8)
    path = decode.balanced_path(beam, t, s, MatchParams(top_k=8, lambda_balance=1.2, balance_iters=3))
    return decode.song_shares(path.join(beam, ["target", "t", "j"]))


@query("share_swaps")
def share_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles after quota swaps and run absorption: greedy loops, checked in the tests by behaviour."""
    beam, _, s = _beam(spark, sf_dir, 8)
    tiles = decode.enforce_max_share(beam.where("j = 1"), beam, s, 0.3)
    return decode.enforce_min_runs(tiles, s, 2, 0.22, 0.4)


@query("chroma_cosine", f"WITH {DESC} SELECT t.song_id AS target, round(least(greatest(avg(list_inner_product(t.chroma, s.chroma) / (sqrt(list_inner_product(t.chroma, t.chroma)) * sqrt(list_inner_product(s.chroma, s.chroma)))), 0), 1), 6) AS chroma FROM tgt t JOIN src s ON s.segment_idx = t.segment_idx AND s.song_id = chr(CAST(60 + t.label AS INTEGER)) GROUP BY t.song_id")
def chroma_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = _sides(spark, sf_dir)
    other = s.select("segment_idx", F.col("label").alias("l"), F.col("chroma").alias("b"))
    rows = t.select(F.col("song_id").alias("target"), "segment_idx", (F.col("label") - 5).alias("l"), F.col("chroma").alias("a")).join(other, ["segment_idx", "l"])
    return measures.chroma_cosine(rows).withColumn("chroma", F.round("chroma", 6))


@query(
    "quality_gate",
    f"WITH {DESC}, m AS (SELECT song_id || '-' || segment_idx AS target, level AS bc, chroma[1] AS bo, 1 + register[1] AS bm, energy[1] / 4 AS bb, level + chroma[2] / 4 AS oc, chroma[3] AS oo, 1 + register[2] AS om, energy[2] / 4 AS ob FROM tgt), "
    "q AS (SELECT *, CAST(0.48 AS DOUBLE) * bc + CAST(0.29 AS DOUBLE) * bo - CAST(0.18 AS DOUBLE) * least(2, bm) / 2 - CAST(0.05 AS DOUBLE) * least(1, bb) AS bs, CAST(0.48 AS DOUBLE) * oc + CAST(0.29 AS DOUBLE) * oo - CAST(0.18 AS DOUBLE) * least(2, om) / 2 - CAST(0.05 AS DOUBLE) * least(1, ob) AS os FROM m) "
    "SELECT target, round(bs, 6) AS base_score, round(os, 6) AS other_score, (oc + CAST(0.005 AS DOUBLE) >= bc AND oo + CAST(0.03 AS DOUBLE) >= bo AND om <= CAST(1.05 AS DOUBLE) * bm AND ob <= greatest(bb + CAST(0.02 AS DOUBLE), CAST(1.5 AS DOUBLE) * bb) AND os >= bs + CAST(0.02 AS DOUBLE)) AS accepted FROM q",
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _sides(spark, sf_dir)[0]

    def at(c: str, i: int) -> F.Column:
        return F.get(c, F.lit(i))

    def metrics(*x: F.Column) -> F.Column:
        return F.struct(*(v.alias(n) for v, n in zip(x, ("chroma", "onset", "log_mel", "boundary"))))

    rows = t.select(
        F.concat_ws("-", "song_id", "segment_idx").alias("target"),
        metrics(F.col("level"), at("chroma", 0), 1 + at("register", 0), at("energy", 0) / 4).alias("base"),
        metrics(F.col("level") + at("chroma", 1) / 4, at("chroma", 2), 1 + at("register", 1), at("energy", 1) / 4).alias("other"),
    )
    return measures.choose_renderer(rows).withColumns({"base_score": F.round("base_score", 6), "other_score": F.round("other_score", 6)})


@query("tile_document", f"WITH {BEAM4} SELECT target, CAST(count(*) AS BIGINT) AS tiles, string_agg(source_id || ':' || key_shift, ',' ORDER BY t) AS tile_list FROM beam WHERE j = 1 GROUP BY target")
def tile_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _beam(spark, sf_dir)[0].where("j = 1").select("target", F.struct("t", F.concat_ws(":", "source_id", "key_shift").alias("x")).alias("r"))
    return rows.groupBy("target").agg(F.count("*").alias("tiles"), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"]), ",").alias("tile_list"))


@query("stacked_packs", f"WITH {DESC} SELECT song_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT segment_idx) AS BIGINT) AS segments, max(end_s) AS end_s FROM src GROUP BY song_id")
def stacked_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of each song's rows, as one pack."""
    s = _sides(spark, sf_dir)[1]
    parts = [s.where(F.col("song_id") == x) for x in catalog.SOURCES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("song_id").agg(F.count("*").alias("n"), F.countDistinct("segment_idx").alias("segments"), F.max("end_s").alias("end_s"))



@query("clip_ids", f"WITH {DESC} SELECT song_id, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(source_id AS VARCHAR), ',' ORDER BY start_s, source_id) AS ids FROM src GROUP BY song_id")
def clip_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode.clip_ids(_sides(spark, sf_dir)[1])
    return rows.select("song_id", F.size("ids").cast("long").alias("n"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("missing_songs", f"WITH {BEAM4} SELECT target, song_id FROM (SELECT DISTINCT target || '-' || CAST((t - 1) // 5 AS VARCHAR) AS target FROM beam), (SELECT DISTINCT song_id FROM src) EXCEPT SELECT target || '-' || CAST((t - 1) // 5 AS VARCHAR), song_id FROM beam WHERE j = 1")
def missing_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs that the best rows of every five steps of a target leave out; each five steps are a target here."""
    beam, _, s = _beam(spark, sf_dir)
    fives = F.concat("target", F.lit("-"), F.floor((F.col("t") - 1) / 5).cast("string"))
    return decode.missing_songs(beam.where("j = 1").withColumn("target", fives), s)


@query("slices", f"WITH {DESC}, p AS (SELECT source_id, temporal AS x, source_id % 60 AS a FROM seg) SELECT source_id, round(list_sum(x[a+1:a+16]), 6) AS total, CAST(CASE WHEN a < 48 THEN 16 ELSE 0 END AS BIGINT) AS n, round(list_sum(x[1:20]), 6) AS fit FROM p")
def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.vectors import total

    d = catalog.descriptors(catalog.table(spark, sf_dir, "embeddings"))
    w = window_at("temporal", F.col("source_id") % 60, 16)
    return d.select("source_id", F.round(total(w), 6).alias("total"), F.when(w.isNotNull(), F.size(w).cast("long")).otherwise(F.lit(0).cast("long")).alias("n"), F.round(total(fit_length("temporal", 20)), 6).alias("fit"))


@query("tile_frames", f"WITH {DESC} SELECT source_id, CAST(least(greatest(round_even(start_s * 22050 / 512, 0), 0), 299) AS BIGINT) AS frame FROM src")
def tile_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir)[1].select("source_id", frame_of(F.col("start_s"), 22050, 512, F.lit(300).cast("long")).alias("frame"))


@query("tile_display", f"WITH {BEAM4} SELECT target, t, CAST(CAST(floor(c / 6000) AS BIGINT) AS VARCHAR) || ':' || lpad(CAST(CAST(floor(c / 100) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS clock, round(CAST(0.42 AS DOUBLE) + CAST(0.58 AS DOUBLE) * least(greatest(score, 0), 1), 9) AS bright FROM (SELECT target, t, score, CAST(floor((t - 1) * CAST(2.375 AS DOUBLE) * 100 + 0.5) AS BIGINT) AS c FROM beam WHERE j = 1)")
def tile_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _beam(spark, sf_dir)[0].where("j = 1")
    return rows.select("target", "t", clock_hundredths((F.col("t") - 1) * 2.375).alias("clock"), F.round(brightness(F.col("score")), 9).alias("bright"))


PICKS = "list_filter({0}, lambda x, i: list_position({0}, x) = i)[1:16]"
CANDIDATES = f"""{SCORE}{KNN},
nea AS (SELECT *, CAST(row_number() OVER (PARTITION BY target, t ORDER BY score DESC, source_id) AS BIGINT) AS r FROM score QUALIFY r <= 8),
ent AS (SELECT target, t, source_id, 0 AS kind, '' AS song, r, 0 AS side FROM nea UNION ALL SELECT target, t, source_id, 1, song_id, r, 0 FROM knn
  UNION ALL SELECT n.target, n.t, b.source_id, 2, '', n.r, CASE WHEN b.segment_idx < s.segment_idx THEN 0 ELSE 1 END FROM nea n JOIN src s USING (source_id) JOIN src b ON b.song_id = s.song_id AND abs(b.segment_idx - s.segment_idx) = 1 WHERE n.r <= 4),
bas AS (SELECT target, t, list(source_id ORDER BY kind, song, r, side) AS l, list(source_id ORDER BY r) FILTER (WHERE kind = 0) AS near FROM ent GROUP BY ALL),
nxt AS (SELECT map(list(s.source_id), list(n.source_id)) AS m FROM src s JOIN src n ON n.song_id = s.song_id AND n.segment_idx = s.segment_idx + 1),
cbm AS (SELECT target, t, near, {PICKS.format('l')} AS p FROM bas WHERE t = 1
  UNION ALL
  SELECT target, t, near, {PICKS.format('l')} FROM (SELECT b.target, b.t, b.near, b.l || list_filter([m[x] FOR x IN c.p[1:4]], lambda x: x IS NOT NULL) AS l FROM cbm c JOIN bas b ON b.target = c.target AND b.t = c.t + 1, nxt)),
cnd AS (SELECT target, t, slot, CASE WHEN slot <= len(p) THEN p[slot] ELSE near[(slot - len(p) - 1) % len(near) + 1] END AS source_id FROM (SELECT *, unnest(range(1, 17)) AS slot FROM cbm))"""


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t, s = _sides(spark, sf_dir)
    atoms = s.select("source_id", "song_id", F.col("segment_idx").alias("frame"))
    scored = search.scored(t, s, 16).unionByName(search.scored(t, s, 2, True)).dropDuplicates(["target", "t", "source_id"])
    scored = shared.written(scored, "scored")
    return factorize.candidate_beam(scored, atoms, 16), atoms


@query("candidate_beam", f"WITH RECURSIVE {CANDIDATES} SELECT target, t, slot, source_id FROM cnd")
def candidate_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by priority; SQL builds row after row."""
    return _candidates(spark, sf_dir)[0]


@query("atom_index", f"WITH RECURSIVE {CANDIDATES} SELECT target, t, slot, source_id, CAST(dense_rank() OVER (ORDER BY s.song_id, s.segment_idx) - 1 AS BIGINT) AS atom FROM cnd JOIN src s USING (source_id)")
def atom_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The used atoms numbered without gaps by song and frame, and each candidate's number."""
    beam, atoms = _candidates(spark, sf_dir)
    return numbering.dense_index(beam.join(atoms, "source_id"), ["song_id", "frame"], "atom")[1].select("target", "t", "slot", "source_id", "atom")


@query("match_sequence")
def match_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole matcher's figures: its parts are checked one by one."""
    t, s = _sides(spark, sf_dir)
    p = MatchParams(top_k=8, max_share=0.5, min_run=2, n_layers=2, lambda_balance=0.5)
    return mosaic.match_sequence(t, s, p).summary


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    beam, t, s = _beam(spark, sf_dir, 12)
    return documents.documents(beam.where("j = 1"), decode.layers(beam.where("j = 1"), beam, t, s, LAYER_P))


@query("mosaic_documents")
def mosaic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents of the best tiles and their layers; SQL sees them read back (documents_round_trip)."""
    return _documents(spark, sf_dir)


@query(
    "documents_round_trip",
    f"WITH {LAYER_SQL}, own AS (SELECT b.target, b.t, b.source_id, b.song_id, b.key_shift, b.score, b.song_id <> lag(b.song_id) OVER (PARTITION BY b.target ORDER BY b.t) AS c FROM beam b WHERE b.j = 1), s AS (SELECT target, CAST(count(*) AS BIGINT) AS tiles, CAST(coalesce(sum(c::INT), 0) AS BIGINT) AS transitions, round(avg(score), 4) AS similarity FROM own GROUP BY target) "
    "SELECT o.target, s.tiles, s.transitions, s.similarity, o.t, o.source_id AS tile, o.key_shift, round(o.score, 4) AS score, l.layer, l.source_id, l.song_id, round(l.weight, 4) AS weight FROM own o JOIN s USING (target) JOIN lay l ON l.target = o.target AND l.t = o.t",
)
def documents_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as JSON lines and read again: a row for each layer of each tile."""
    import uuid

    path = f"{shared.shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    documents.write_documents(_documents(spark, sf_dir), path)
    rows = documents.read_documents(spark, path).select("target", "stats.*", F.explode("tiles").alias("x"))
    return rows.select("target", "tiles", "transitions", "similarity", "x.t", F.col("x.source_id").alias("tile"), "x.key_shift", "x.score", F.posexplode("x.layers").alias("layer", "l")).select("target", "tiles", "transitions", "similarity", "t", "tile", "key_shift", "score", F.col("layer").cast("long").alias("layer"), "l.source_id", "l.song_id", "l.weight")
