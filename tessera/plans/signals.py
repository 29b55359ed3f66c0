"""Registered queries on event streams as signals, and on links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.arrays import clock
from ..operators import numbering
from ..operators import signals as ops
from ..sources import catalog
from .registry import query

SIG = """sig AS (SELECT user_id AS song_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i, CAST(value AS DOUBLE) AS y, epoch_us(ts) AS m FROM events),
sgt AS (SELECT song_id, i, y, (m - min(m) OVER (PARTITION BY song_id)) / 1e6 AS t FROM sig)"""
HOP, GAP, WINDOW = 21_600.0, 7_560.0, 44_181.0  # seconds: the .22, .08 and .45 of sound, at the pace of events


def _sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.signals(catalog.table(spark, sf_dir, "events"))


@query("peak_normalize", f"WITH {SIG}, p AS (SELECT song_id, max(abs(y)) AS m FROM sgt GROUP BY song_id) SELECT song_id, i, round(least(greatest(y / coalesce(nullif(m, 0), 1) * CAST(0.9 AS DOUBLE), -1), 1), 6) AS y FROM sgt JOIN p USING (song_id)")
def peak_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.peak_normalize(_sig(spark, sf_dir)).select("song_id", "i", F.round("y", 6).alias("y"))


@query("pcm_sink", f"WITH {SIG}, p AS (SELECT song_id, max(abs(y)) AS m FROM sgt GROUP BY song_id) SELECT song_id, CAST(count(*) AS BIGINT) AS n, CAST(max(CAST(round(least(greatest(y / coalesce(nullif(m, 0), 1) * CAST(0.89 AS DOUBLE), -1), 1) * 32767) AS BIGINT)) AS BIGINT) AS top FROM sgt JOIN p USING (song_id) GROUP BY song_id")
def pcm_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pcm16(_sig(spark, sf_dir)).groupBy("song_id").agg(F.count("*").alias("n"), F.max("y").cast("long").alias("top"))


@query("level", f"WITH {SIG}, r AS (SELECT song_id, sqrt(avg(y * y) + 1e-12) AS r FROM sgt GROUP BY song_id) SELECT song_id, round(r, 6) AS rms, round(least(greatest((20 * log10(r + 1e-8) + 60) / 60, 0), 1), 6) AS level FROM r")
def level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.levels(_sig(spark, sf_dir)).select("song_id", F.round("rms", 6).alias("rms"), F.round("level", 6).alias("level"))


@query("mean_std", f"WITH {SIG} SELECT song_id, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS std FROM sgt GROUP BY song_id")
def mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.mean_std(_sig(spark, sf_dir)).select("song_id", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


FRAMES = f"{SIG}, frm AS (SELECT s.song_id, f.f AS frame, sqrt(avg(s.y * s.y) + 1e-12) AS rms FROM sgt s JOIN (SELECT DISTINCT song_id, i // 8 AS f FROM sgt) f ON f.song_id = s.song_id AND s.i >= f.f * 8 AND s.i < f.f * 8 + 16 GROUP BY ALL)"


@query("frame_rms", f"WITH {FRAMES} SELECT song_id, CAST(frame AS BIGINT) AS frame, round(rms, 6) AS rms FROM frm")
def frame_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.frame_rms(_sig(spark, sf_dir)).select("song_id", "frame", F.round("rms", 6).alias("rms"))


@query("moving_avg5", f"WITH {FRAMES} SELECT song_id, CAST(frame AS BIGINT) AS frame, round(sum(rms) OVER (PARTITION BY song_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM frm")
def moving_avg5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.moving_average(ops.frame_rms(_sig(spark, sf_dir)), "rms", "frame").select("song_id", "frame", F.round("smooth", 6).alias("smooth"))


@query("smooth3", f"WITH {SIG} SELECT song_id, i, round(y / 2 + coalesce(lag(y) OVER w, y) / 4 + coalesce(lead(y) OVER w, y) / 4, 6) AS smooth FROM sgt WINDOW w AS (PARTITION BY song_id ORDER BY i)")
def smooth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.smooth3(_sig(spark, sf_dir), "y", "i").select("song_id", "i", F.round("smooth", 6).alias("smooth"))


@query("temporal_pool", f"WITH {SIG}, b AS (SELECT song_id, ntile(4) OVER (PARTITION BY song_id ORDER BY i) AS bin, y FROM sgt), g AS (SELECT DISTINCT song_id, bin FROM sgt, (SELECT unnest(range(1, 5)) AS bin)) SELECT g.song_id, CAST(g.bin AS BIGINT) AS bin, round(coalesce(avg(b.y), 0), 6) AS mean FROM g LEFT JOIN b ON b.song_id = g.song_id AND b.bin = g.bin GROUP BY ALL")
def temporal_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.temporal_pool(_sig(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query("boundary_jump", f"WITH {SIG}, j AS (SELECT song_id, i, abs(y - lag(y) OVER (PARTITION BY song_id ORDER BY i)) / (sqrt(avg(y * y) OVER (PARTITION BY song_id)) + 1e-6) AS j FROM sgt) SELECT song_id, round(coalesce(median(j) FILTER (WHERE i >= 1 AND i % 10 = 0), 0), 6) AS jump FROM j GROUP BY song_id")
def boundary_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.boundary_jump(_sig(spark, sf_dir)).withColumn("jump", F.round("jump", 6))


STARTS = f"""{SIG},
seq AS (SELECT song_id, i, t FROM sgt),
fold AS (SELECT song_id, CAST(-1 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS last, [CAST(0 AS DOUBLE)] AS new FROM seq WHERE i = 0
  UNION ALL
  SELECT s.song_id, s.i, CASE WHEN s.t <= f.last + {GAP} THEN f.last ELSE s.t END, CASE WHEN s.t <= f.last + {GAP} THEN [] ELSE list_append([f.last + {HOP} * k FOR k IN range(1, 1 + CAST(greatest(0, ceil((s.t - f.last) / {HOP} - 1.6)) AS BIGINT))], s.t) END
  FROM fold f JOIN seq s ON s.song_id = f.song_id AND s.i = f.i + 1),
flat AS (SELECT song_id, unnest(new) AS start FROM fold),
sts AS (SELECT song_id, CAST(row_number() OVER (PARTITION BY song_id ORDER BY start) - 1 AS BIGINT) AS place, start FROM flat)"""


@query("onset_starts", f"WITH RECURSIVE {STARTS} SELECT song_id, place, round(start, 3) AS start FROM sts")
def onset_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.event_starts(_sig(spark, sf_dir), HOP, GAP).withColumn("start", F.round("start", 3))


@query("start_filter", f"WITH RECURSIVE {STARTS}, e AS (SELECT song_id, max(t) AS e FROM sgt GROUP BY song_id), k AS (SELECT song_id, place, start FROM sts JOIN e USING (song_id) WHERE start <= greatest(0, e - CAST(0.35 AS DOUBLE) * {WINDOW})) SELECT song_id, place, round(start, 3) AS start FROM k QUALIFY count(*) OVER (PARTITION BY song_id) >= 3")
def start_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = _sig(spark, sf_dir)
    ends = sig.groupBy("song_id").agg(F.max("t").alias("end"))
    return ops.starts_within(ops.event_starts(sig, HOP, GAP), ends, WINDOW).withColumn("start", F.round("start", 3))


SPANS = f"{STARTS}, spn AS (SELECT song_id, place, start, start + coalesce(least(greatest(lead(start) OVER (PARTITION BY song_id ORDER BY place) - start + least(CAST(0.08 AS DOUBLE) * 98180, CAST(0.3 AS DOUBLE) * {HOP}), CAST(0.12 AS DOUBLE) * 98180), 2 * {WINDOW}), {WINDOW}) AS e FROM sts)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.segment_spans(ops.event_starts(_sig(spark, sf_dir), HOP, GAP), HOP, WINDOW, 98180.0)


@query("segment_spans", f'WITH RECURSIVE {SPANS} SELECT song_id, place, round(start, 3) AS start, round(e, 3) AS "end" FROM spn')
def segment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).withColumns({"start": F.round("start", 3), "end": F.round("end", 3)})


TILES = f"{SPANS}, tls AS (SELECT song_id, place, CAST(floor(start / 3600) AS BIGINT) AS pos, greatest(1, coalesce(lead(CAST(floor(start / 3600) AS BIGINT)) OVER (PARTITION BY song_id ORDER BY place) - CAST(floor(start / 3600) AS BIGINT), 12)) AS span FROM spn)"
FADES = f"{TILES}, ons AS (SELECT song_id, CAST(floor(t / 3600) AS BIGINT) AS at FROM sgt), nxt AS (SELECT *, lead(span) OVER w AS ns, lead(pos) OVER w AS edge FROM tls WINDOW w AS (PARTITION BY song_id ORDER BY place)), nea AS (SELECT n.*, EXISTS (SELECT 1 FROM ons o WHERE o.song_id = n.song_id AND abs(o.at - n.edge) <= 1) AS near, least(6, span // 2, ns // 2) AS xf FROM nxt n), sem AS (SELECT *, greatest(xf, least(2, span, ns)) AS seam FROM nea), fad AS (SELECT song_id, place, pos, span, CAST(CASE WHEN edge IS NULL THEN 0 WHEN near THEN least(seam, greatest(1, least(greatest(2, CAST(round_even(xf * CAST(0.35 AS DOUBLE), 0) AS BIGINT)), span, ns))) ELSE seam END AS BIGINT) AS fade FROM sem)"


def _fades(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    spans = _spans(spark, sf_dir).withColumn("pos", F.floor(F.col("start") / 3600))
    gap = F.lead("pos").over(Window.partitionBy("song_id").orderBy("place")) - F.col("pos")
    tiles = spans.select("song_id", "place", "pos", F.greatest(F.lit(1), F.coalesce(gap, F.lit(12))).cast("long").alias("span"))
    onsets = _sig(spark, sf_dir).select("song_id", F.floor(F.col("t") / 3600).alias("at"))
    return ops.seam_fades(tiles, onsets, 6, 2, 1)


@query("seam_xf", f"WITH RECURSIVE {FADES} SELECT song_id, place, pos, span, fade FROM fad")
def seam_xf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fades(spark, sf_dir)


@query(
    "overlap_add",
    f"WITH RECURSIVE {FADES}, ola AS (SELECT song_id, place, pos, span + fade AS length, coalesce(lag(fade) OVER (PARTITION BY song_id ORDER BY place), 0) AS fi, fade AS fo, CAST(1 + place % 5 AS DOUBLE) AS v FROM fad), smp AS (SELECT *, unnest(range(0, length)) AS k FROM ola), "
    'env AS (SELECT song_id, pos + k AS "at", v, CASE WHEN k < fi THEN sin(pi() / 2 * k / fi) ELSE 1 END * CASE WHEN k >= length - fo THEN CASE WHEN fo <= 1 THEN 1 ELSE cos(pi() / 2 * (k - (length - fo)) / (fo - 1)) END ELSE 1 END AS w FROM smp) '
    'SELECT song_id, "at", round(CASE WHEN sum(w) > 1e-6 THEN sum(w * v) / sum(w) ELSE sum(w * v) END, 6) AS y FROM env GROUP BY song_id, "at"',
)
def overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("song_id").orderBy("place")
    tiles = _fades(spark, sf_dir).select("song_id", "place", "pos", (F.col("span") + F.col("fade")).alias("length"), F.coalesce(F.lag("fade").over(w), F.lit(0)).alias("fade_in"), F.col("fade").alias("fade_out"), (1 + F.col("place") % 5).cast("double").alias("value"))
    return ops.overlap_add(tiles).withColumn("y", F.round("y", 6))


@query("onset_corr", f"WITH {SIG}, p AS (SELECT song_id, y AS a, lead(y) OVER (PARTITION BY song_id ORDER BY i) AS b FROM sgt), q AS (SELECT * FROM p WHERE b IS NOT NULL) SELECT song_id, round(CASE WHEN count(*) < 2 OR stddev_pop(a) < 1e-8 OR stddev_pop(b) < 1e-8 THEN 0 ELSE least(greatest(corr(a, b), -1), 1) END, 6) AS r FROM q GROUP BY song_id")
def onset_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("song_id").orderBy("i")
    rows = _sig(spark, sf_dir).select("song_id", F.col("y").alias("a"), F.lead("y").over(w).alias("b")).where("b is not null")
    return ops.correlation(rows).withColumn("r", F.round("r", 6))


@query("soft_limit", f"WITH {SIG}, p AS (SELECT song_id, max(abs(y)) AS m FROM sgt GROUP BY song_id) SELECT song_id, i, round(CASE WHEN m > 99 THEN y / m * 99 ELSE y END, 6) AS y FROM sgt JOIN p USING (song_id)")
def soft_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.soft_limit(_sig(spark, sf_dir), 99.0).select("song_id", "i", F.round("y", 6).alias("y"))


@query(
    "interpolate",
    f"WITH {FRAMES}, pts AS (SELECT song_id, frame * 8 + 8 AS x, rms AS y FROM frm), xs AS (SELECT song_id, i AS x FROM sgt), "
    "ab AS (SELECT q.song_id, q.x, (SELECT max(x) FROM pts p WHERE p.song_id = q.song_id AND p.x <= q.x) AS xa, (SELECT min(x) FROM pts p WHERE p.song_id = q.song_id AND p.x >= q.x) AS xb FROM xs q) "
    "SELECT q.song_id, q.x, round(CASE WHEN xa IS NULL THEN b.y WHEN xb IS NULL OR xa = xb THEN a.y ELSE a.y + (b.y - a.y) * (q.x - xa) / (xb - xa) END, 6) AS y FROM ab q LEFT JOIN pts a ON a.song_id = q.song_id AND a.x = q.xa LEFT JOIN pts b ON b.song_id = q.song_id AND b.x = q.xb",
)
def interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = _sig(spark, sf_dir)
    points = ops.frame_rms(sig).select("song_id", (F.col("frame") * 8 + 8).alias("x"), F.col("rms").alias("y"))
    return ops.interpolated(points, sig.select("song_id", F.col("i").alias("x"))).withColumn("y", F.round("y", 6))


@query("loudness_gain", f"WITH {SIG}, r AS (SELECT song_id, sqrt(avg(y * y) + 1e-12) AS r FROM sgt GROUP BY song_id), q AS (SELECT *, lag(r, 1, r) OVER (ORDER BY song_id) AS ref FROM r) SELECT song_id, round(least(greatest(power(ref / r, CAST(0.85 AS DOUBLE)), 0.35), 3.5), 6) AS gain FROM q")
def loudness_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each song against the one before it in id order."""
    r = numbering.numbered(ops.levels(_sig(spark, sf_dir)).select("song_id", "rms"), ["song_id"])
    before = r.select((F.col("place") + 1).alias("place"), F.col("rms").alias("ref"))
    return r.join(before, "place", "left").select("song_id", F.round(ops.loudness_gain(F.col("rms"), F.coalesce("ref", "rms")), 6).alias("gain"))


HOSTS = tuple(f"{p}{h}.example.{e}" for p in ("", "m.") for h in ("ththre", "ththth", "thther", "tionsh", "thththre") for e in ("com", "net", "org"))
_HOSTS = "(" + ", ".join(f"'{h}'" for h in HOSTS) + ")"
_RE = "^(https?://)?(" + "|".join(h.replace(".", "\\.") for h in sorted(HOSTS, key=len, reverse=True)) + ")/"
URL = f"u AS (SELECT page_id, trim(url) AS u FROM pages), w AS (SELECT page_id, u, CASE WHEN contains(u, '://') THEN u ELSE 'https://' || u END AS v FROM u), h AS (SELECT *, lower(regexp_extract(v, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM w), ok AS (SELECT *, coalesce(regexp_matches(lower(u), '{_RE}') AND host IN {_HOSTS}, false) AS ok FROM h)"


@query("url_valid", f"WITH {URL} SELECT page_id, ok AS valid, CASE WHEN ok THEN CASE WHEN starts_with(u, 'http') THEN u ELSE 'https://' || u END END AS normal FROM ok")
def url_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = catalog.table(spark, sf_dir, "pages")
    return p.select("page_id", urls.is_allowed(F.col("url"), HOSTS).alias("valid"), urls.normal_form(F.col("url"), HOSTS).alias("normal"))


_LINK = "CASE page_id % 6 WHEN 0 THEN 'https://youtu.be/abc_' || page_id || '?t=1' WHEN 1 THEN 'www.youtube.com/watch?a=b&v=vid-' || page_id || '#x' WHEN 2 THEN 'https://m.youtube.com/shorts/s' || (page_id + 100000) || '/' WHEN 3 THEN 'http://127.0.0.1/v=' || page_id WHEN 4 THEN 'https://evil.com/?u=youtube.com' ELSE url END"


@query(
    "url_video_id",
    f"WITH l AS (SELECT page_id, {_LINK} AS u FROM pages), "
    "w AS (SELECT *, CASE WHEN contains(u, '://') THEN u ELSE 'https://' || u END AS v FROM l), h AS (SELECT *, lower(regexp_extract(v, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM w), "
    "ok AS (SELECT *, regexp_matches(lower(u), '^(https?://)?(www\\.youtube\\.com|m\\.youtube\\.com|www\\.youtu\\.be|youtube\\.com|youtu\\.be)/') AS ok FROM h), "
    "f AS (SELECT page_id, CASE WHEN NOT ok THEN NULL WHEN host IN ('youtu.be', 'www.youtu.be') THEN regexp_extract(v, '^[^:]+://[^/?#]*/+([^/?#]*)', 1) WHEN regexp_extract(v, '^[^?#]*\\?(?:[^#]*&)?v=([^&#]+)', 1) <> '' THEN regexp_extract(v, '^[^?#]*\\?(?:[^#]*&)?v=([^&#]+)', 1) ELSE regexp_extract(v, '^[^:]+://[^/?#]*/+(?:shorts|embed|live)/+([^/?#]+)', 1) END AS id FROM ok) "
    "SELECT page_id, CASE WHEN regexp_matches(id, '^[A-Za-z0-9_-]{6,20}$') THEN id END AS video_id FROM f",
)
def url_video_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = F.col("page_id"), F.col("page_id").cast("string")
    link = (
        F.when(n % 6 == 0, F.concat(F.lit("https://youtu.be/abc_"), s, F.lit("?t=1")))
        .when(n % 6 == 1, F.concat(F.lit("www.youtube.com/watch?a=b&v=vid-"), s, F.lit("#x")))
        .when(n % 6 == 2, F.concat(F.lit("https://m.youtube.com/shorts/s"), (n + 100000).cast("string"), F.lit("/")))
        .when(n % 6 == 3, F.concat(F.lit("http://127.0.0.1/v="), s))
        .when(n % 6 == 4, F.lit("https://evil.com/?u=youtube.com"))
        .otherwise(F.col("url"))
    )
    return catalog.table(spark, sf_dir, "pages").select("page_id", urls.video_id(link).alias("video_id"))


@query("search_text", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(trim(text)), 'song|songs|music|track|tracks|audio|official') THEN trim(text) ELSE trim(text) || ' songs' END AS q FROM conversations")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "conversations").select("conv_id", "turn", urls.search_text(F.col("text")).alias("q"))


@query("job_key", "SELECT item_id, substr(md5(text), 1, 12) AS key, regexp_matches(substr(md5(text), 1, 12), '^[a-f0-9]{12}$') AS ok FROM benchmark")
def job_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.substring(F.md5("text"), 1, 12)
    return catalog.table(spark, sf_dir, "benchmark").select("item_id", key.alias("key"), urls.is_job_id(key).alias("ok"))


@query("result_limit", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 5 AND 30 ORDER BY l_orderkey, l_linenumber LIMIT 20")
def result_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hits whose length is within bounds: a limit is the feature."""
    rows = catalog.table(spark, sf_dir, "lineitem").where("l_quantity between 5 and 30")
    return rows.orderBy("l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_quantity").limit(20)


@query("display_times", f"WITH {SIG}, e AS (SELECT song_id, max(t) / 1000 AS s FROM sgt GROUP BY song_id) SELECT song_id, CAST(floor(s / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(s) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock FROM e")
def display_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _sig(spark, sf_dir).groupBy("song_id").agg((F.max("t") / 1000).alias("s"))
    return e.select("song_id", clock(F.col("s")).alias("clock"))
