"""Registered queries that turn tiles into sound: the songs' waveforms are their vectors laid end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.costs import role
from ..operators import render
from ..sources import catalog, shared
from .frames import FLUX, song_onsets
from .matching import LAYER_SQL, _layers, _sides
from .registry import query

SR, WINDOW, SIZE = 291, 0.45, 512  # a hop of .22 s is one vector
GUARD = max(16, round(0.004 * SR))
STEMMED = ("A", "B")  # songs that have stems too
X = "CAST({} AS DOUBLE)".format
WAV = """wav AS (SELECT song_id, flatten(list(e ORDER BY segment_idx)) AS y FROM src JOIN raw USING (source_id) GROUP BY song_id),
kin AS (SELECT song_id, y, [greatest(v, 0) FOR v IN y] AS drums, [least(v, 0) FOR v IN y] AS bass, [v * v FOR v IN y] AS other, [abs(v) / 2 FOR v IN y] AS vocals FROM wav)"""
PLAN = f"""{FLUX},
ons AS (SELECT song_id AS target, CAST(start AS BIGINT) * 64 AS "at" FROM fo WHERE ok),
tp AS (SELECT song_id AS target, segment_idx - 1 AS place, start_s, CAST(round_even(start_s * {SR}, 0) AS BIGINT) AS pos, CAST(round_even(least(greatest(end_s - start_s, {X(.12)}), {X(2 * WINDOW)}) * {SR}, 0) AS BIGINT) AS win FROM tgt),
fst AS (SELECT l.target, l.t - 1 AS place, l.song_id, s.start_s AS source_s FROM lay l JOIN src s USING (source_id) WHERE l.layer = 0),
ps AS (SELECT *, greatest(1, coalesce(lead(pos) OVER w - pos, win)) AS span, lead(pos) OVER w AS edge, lead(song_id) OVER w AS next_song, lead(source_s) OVER w AS next_s FROM tp JOIN fst USING (target, place) WINDOW w AS (PARTITION BY target ORDER BY place)),
pn AS (SELECT *, lead(span) OVER (PARTITION BY target ORDER BY place) AS next_span FROM ps),
px AS (SELECT *, least({round(.03 * SR)}, span // 2, next_span // 2) AS xf, greatest(1, edge - pos) / CAST({SR} AS DOUBLE) AS step FROM pn),
pe AS (SELECT *, greatest(xf, least({GUARD}, span, next_span)) AS seam, EXISTS (SELECT 1 FROM ons o WHERE o.target = px.target AND abs(o."at" - px.edge) <= {round(.02 * SR)}) AS near FROM px),
pf AS (SELECT *, CASE WHEN edge IS NULL THEN 0 WHEN near THEN least(seam, greatest(1, least(greatest({GUARD}, CAST(round_even(xf * {X(.35)}, 0) AS BIGINT)), span, next_span))) ELSE seam END AS fade_out, edge IS NOT NULL AND NOT (song_id = next_song AND abs(source_s + step - next_s) <= greatest({X(.06)}, step * {X(.55)})) AS pow FROM pe),
plan AS (SELECT target, place, pos, greatest(win, span + fade_out) AS length, coalesce(lag(fade_out) OVER w, 0) AS fade_in, fade_out, coalesce(lag(pow) OVER w, false) AS power, CAST(round_even((max(start_s) OVER (PARTITION BY target) + {X(WINDOW)}) * {SR}, 0) AS BIGINT) AS n_out FROM pf WINDOW w AS (PARTITION BY target ORDER BY place))"""
CLIPS = f"""{LAYER_SQL}, {WAV}, {PLAN},
req AS (SELECT l.target, l.t - 1 AS place, l.layer, l.source_id, l.song_id, l.weight, r.role, p.length AS n, CAST(round_even(s.start_s * {SR}, 0) AS BIGINT) AS a FROM lay l JOIN src s USING (source_id) JOIN rol r USING (source_id) JOIN plan p ON p.target = l.target AND p.place = l.t - 1),
clp AS (SELECT q.*, list_resize(CASE WHEN song_id NOT IN {STEMMED} THEN y[a + 1:a + n] WHEN role = 'drums' THEN drums[a + 1:a + n] WHEN role = 'bass' THEN bass[a + 1:a + n] WHEN role = 'harmonic' THEN [other[i] * {X(.65)} + vocals[i] * {X(.35)} FOR i IN range(a + 1, least(a + n, len(y)) + 1)]
  ELSE [{X(.5)} * bass[i] + {X(.5)} * drums[i] + {X(.5)} * other[i] + {X(.5)} * vocals[i] FOR i IN range(a + 1, least(a + n, len(y)) + 1)] END, n, {X(0)}) AS x FROM req q JOIN kin USING (song_id))"""
LIMIT = "CASE WHEN list_max([abs(v) FOR v IN {0}]) > 0.99 THEN [v * (" + X(.99) + " / list_max([abs(v) FOR v IN {0}])) FOR v IN {0}] ELSE {0} END"


def _adding(name: str, before: str, layer: int) -> str:
    """Table `name`: `before` with the layer's samples added and limited."""
    add = f"CASE WHEN c.x IS NULL THEN m.x ELSE [m.x[i] + least(greatest(c.weight * {X(1.35)}, {X(.12)}), {X(.55)}) * c.x[i] FOR i IN range(1, len(m.x) + 1)] END"
    return f"{name}_ AS (SELECT m.target, m.place, c.x IS NOT NULL AS added, {add} AS x FROM {before} m LEFT JOIN clp c ON c.target = m.target AND c.place = m.place AND c.layer = {layer}),\n{name} AS (SELECT target, place, CASE WHEN added THEN {LIMIT.format('x')} ELSE x END AS x FROM {name}_)"


RENDER = f"""{CLIPS}, m0 AS (SELECT target, place, x FROM clp WHERE layer = 0), {_adding('m1', 'm0', 1)}, {_adding('m2', 'm1', 2)},
mix AS (SELECT target, place, CASE WHEN abs(list_sum(x) / len(x)) < {X(.2)} * (list_max([abs(v) FOR v IN x]) + 1e-9) THEN [v - list_sum(x) / len(x) FOR v IN x] ELSE x END AS x FROM m2),
smp AS (SELECT p.*, unnest(range(0, length)) AS k, unnest(x) AS x FROM plan p JOIN mix USING (target, place) WHERE pos < n_out),
env AS (SELECT target, pos + k AS i, n_out, x, CASE WHEN k < fade_in THEN sin(pi() / 2 * k / fade_in) ELSE 1 END * CASE WHEN k >= length - fade_out THEN CASE WHEN fade_out <= 1 THEN 1 ELSE cos(pi() / 2 * (k - (length - fade_out)) / (fade_out - 1)) END ELSE 1 END AS w,
  CASE WHEN power AND k < fade_in THEN power(sin(pi() * k / greatest(fade_in - 1, 1)), 2) ELSE 0 END AS ease FROM smp WHERE pos + k < n_out),
sums AS (SELECT target, i, sum(w * x) AS s, sum(w) AS w, sum(w * w) AS w2, max(ease) AS ease, max(n_out) AS n_out FROM env GROUP BY ALL),
raw_ AS (SELECT target, i, n_out, least({GUARD}, n_out // 2) AS g, CASE WHEN (1 - ease) * w + ease * sqrt(greatest(w2, 1e-12)) > 1e-6 THEN s / ((1 - ease) * w + ease * sqrt(greatest(w2, 1e-12))) ELSE s END AS y FROM sums),
ramp AS (SELECT target, i, y * CASE WHEN g > 1 AND i < g THEN sin(pi() / 2 * i / (g - 1)) ELSE 1 END * CASE WHEN g > 1 AND n_out - 1 - i < g THEN sin(pi() / 2 * (n_out - 1 - i) / (g - 1)) ELSE 1 END AS y FROM raw_),
out AS (SELECT target, i, y * CASE WHEN max(abs(y)) OVER (PARTITION BY target) > 0.99 THEN {X(.99)} / max(abs(y)) OVER (PARTITION BY target) ELSE 1 END AS y FROM ramp)"""


def _waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source songs in blocks, and stems of two of them: rises, falls, squares and sizes of their samples."""
    e = catalog.table(spark, sf_dir, "embeddings").where("embedding is not null and label < 5")
    rows = e.select(F.chr(F.col("label") + 65).alias("song_id"), F.col("vec_id").alias("piece"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    y = F.col("samples")
    kinds = {"drums": lambda v: F.greatest(v, F.lit(0.0)), "bass": lambda v: F.least(v, F.lit(0.0)), "other": lambda v: v * v, "vocals": lambda v: F.abs(v) / 2}
    parts = [F.struct(F.lit("song").alias("kind"), y.alias("samples"))]
    stems = [F.struct(F.lit(k).alias("kind"), F.transform(y, f).alias("samples")) for k, f in kinds.items()]
    rows = rows.select("song_id", "piece", F.inline(F.when(F.col("song_id").isin(*STEMMED), F.array(*parts, *stems)).otherwise(F.array(*parts))))
    return render.wave_blocks(rows, SIZE)


def _tiles(spark: SparkSession, sf_dir: str, beam: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(tiles, layers) of every target, as the renderer takes them."""
    t, s = _sides(spark, sf_dir)
    clip = s.select("source_id", F.col("start_s").alias("source_s"), role("register", "energy").alias("role"))
    layers = shared.written(_layers(spark, sf_dir, beam).join(clip, "source_id").withColumn("place", F.col("t") - 1), "layers")
    first = layers.where("layer = 0").select("target", "place", "song_id", "source_s")
    goal = t.select(F.col("song_id").alias("target"), (F.col("segment_idx") - 1).alias("place"), "start_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"))
    return shared.written(goal.join(first, ["target", "place"]), "tiles"), layers


def _onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return song_onsets(spark, sf_dir).select(F.col("song_id").alias("target"), (F.col("start") * 64).alias("at"))


@query("wave_blocks", f"WITH {LAYER_SQL}, {WAV}, un AS (SELECT song_id, 'song' AS kind, y FROM kin UNION ALL SELECT song_id, unnest(['drums', 'bass', 'other', 'vocals']), unnest([drums, bass, other, vocals]) FROM kin WHERE song_id IN {STEMMED}), b AS (SELECT song_id, kind, y, unnest(range(0, (len(y) + {SIZE - 1}) // {SIZE})) AS block FROM un) SELECT song_id, kind, block, CAST(len(y[block * {SIZE} + 1:(block + 1) * {SIZE}]) AS BIGINT) AS n, round(list_sum(y[block * {SIZE} + 1:(block + 1) * {SIZE}]), 6) AS total FROM b")
def wave_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.vectors import total

    return _waves(spark, sf_dir).select("song_id", "kind", "block", F.size("samples").cast("long").alias("n"), F.round(total(F.col("samples")), 6).alias("total"))


@query("seam_plan", f"WITH RECURSIVE {LAYER_SQL}, {PLAN} SELECT target, place, pos, length, fade_in, fade_out, power, n_out FROM plan")
def seam_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.planned(_tiles(spark, sf_dir)[0], SR, WINDOW, _onsets(spark, sf_dir))


@query("layer_clips", f"WITH RECURSIVE {CLIPS}, u AS (SELECT target, place, layer, song_id, role, unnest(range(0, n)) AS k, unnest(x) AS y FROM clp) SELECT target, place, layer, song_id, role, k, round(y, 6) AS y FROM u")
def layer_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles, layers = _tiles(spark, sf_dir)
    wanted = layers.join(render.planned(tiles, SR, WINDOW, _onsets(spark, sf_dir)).select("target", "place", F.col("length").alias("n")), ["target", "place"])
    clips = render.layer_clips(wanted.withColumn("a", F.rint(F.col("source_s") * SR).cast("long")), _waves(spark, sf_dir), SIZE)
    rows = clips.select("target", "place", "layer", "song_id", "role", F.posexplode("samples").alias("k", "y"))
    return rows.select("target", "place", "layer", "song_id", "role", F.col("k").cast("long").alias("k"), F.round("y", 6).alias("y"))


FOLD = "CASE WHEN s > 6 THEN s - 12 WHEN s < -6 THEN s + 12 ELSE s END"


@query(
    "clip_requests",
    f"WITH RECURSIVE {CLIPS}, rq AS (SELECT q.target, q.place, q.layer, q.song_id, q.role, q.a, q.n, greatest(64, CAST(round_even((s.end_s - s.start_s) * {SR}, 0) AS BIGINT)) AS source_n, CAST(b.key_shift AS DOUBLE) AS s FROM req q JOIN src s USING (source_id) JOIN beam b ON b.target = q.target AND b.t = q.place + 1 AND b.source_id = q.source_id), "
    f"st AS (SELECT *, round(CASE WHEN role = 'drums' THEN CASE WHEN abs({FOLD}) >= 1.5 THEN 0 ELSE least(greatest({FOLD}, -0.35), 0.35) END ELSE {FOLD} END, 1) + 0 AS steps FROM rq) "
    "SELECT target, place, layer, CAST(dense_rank() OVER (ORDER BY song_id, role, a, source_n, n, steps) - 1 AS BIGINT) AS request, steps, round(least(greatest(source_n / CAST(n AS DOUBLE), 0.5), 2), 6) AS pace FROM st",
)
def clip_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each layer's request for a clip, by the number of the distinct request that serves it."""
    from ..functions.costs import fold_shift
    from .matching import _beam

    beam = _beam(spark, sf_dir, 12)[0]
    tiles, layers = _tiles(spark, sf_dir, beam)
    plan = render.planned(tiles, SR, WINDOW, _onsets(spark, sf_dir)).select("target", "place", F.col("length").alias("n"))
    shift = beam.select("target", (F.col("t") - 1).alias("place"), "source_id", "key_shift")
    own = _sides(spark, sf_dir)[1].select("source_id", F.greatest(F.lit(64), F.rint((F.col("end_s") - F.col("start_s")) * SR).cast("long")).alias("source_n"))
    rows = layers.join(plan, ["target", "place"]).join(shift, ["target", "place", "source_id"]).join(own, "source_id")
    rows = rows.withColumns({"a": F.rint(F.col("source_s") * SR).cast("long"), "steps": fold_shift(F.col("key_shift").cast("double"), F.col("role"))})
    requests, numbered = render.clip_requests(rows)
    return numbered.join(requests.select("request", "pace"), "request").select("target", "place", "layer", "request", "steps", F.round("pace", 6).alias("pace"))


@query("ola_render", f'WITH RECURSIVE {RENDER} SELECT target, i AS "at", round(y, 6) + 0 AS y FROM out')
def ola_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles, layers = _tiles(spark, sf_dir)
    return render.rendered(tiles, layers, _waves(spark, sf_dir), SR, WINDOW, _onsets(spark, sf_dir), SIZE).select("target", "at", (F.round("y", 6) + 0.0).alias("y"))


@query("job_quality")
def job_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of both renderings of every target and the one that is taken: the whole job. Parts have SQL, the measures are tested against whole-sound kernels."""
    from ..functions.costs import MatchParams
    from ..operators import job
    from .resynthesis import _waves as waves_of

    t, s = _sides(spark, sf_dir)
    goal = render.wave_blocks(waves_of(spark, sf_dir, True).select("song_id", "kind", F.col("block").alias("piece"), "samples"), SIZE)
    p = job.JobParams(sr=SR, window_s=WINDOW, size=128, hop=64, polyphony=3, block=SIZE)
    out = job.run_job(t, s, goal, _waves(spark, sf_dir), p, MatchParams(top_k=8, n_layers=2), onsets=_onsets(spark, sf_dir)).quality
    return out.select("target", "backend", *(F.col(f"{r}.{m}").alias(f"{r}_{m}") for r in ("unit", "nmf") for m in ("chroma", "onset", "log_mel", "boundary")))
