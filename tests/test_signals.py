"""Signals, links and quality on small inputs."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import costs, urls
from tessera.operators import measures
from tessera.operators import signals as ops


def signal(spark, values, song="x"):
    return spark.createDataFrame([(song, i, float(v)) for i, v in enumerate(values)], "song_id string, i long, y double")


def test_silence_and_peak(spark):
    assert {r["y"] for r in ops.peak_normalize(signal(spark, [0, 0])).collect()} == {0.0}
    assert max(r["y"] for r in ops.peak_normalize(signal(spark, [1, -4])).collect()) == pytest.approx(0.225)


def test_event_starts_fill_gaps(spark):
    events = spark.createDataFrame([("x", t) for t in (0.05, 0.5, 0.55, 2.0)], "song_id string, t double")
    got = [r["start"] for r in ops.event_starts(events, 0.5, 0.175).orderBy("place").collect()]
    assert got == pytest.approx([0.0, 0.5, 1.0, 1.5, 2.0])


def test_overlap_add_keeps_a_constant(spark):
    tiles = spark.createDataFrame([("x", 0, 0, 10, 0, 4, 2.0), ("x", 1, 6, 10, 4, 0, 2.0)], "song_id string, place long, pos long, length long, fade_in long, fade_out long, value double")
    got = ops.overlap_add(tiles).toPandas()
    assert len(got) == 16 and got["y"].sub(2.0).abs().max() < 1e-9


def test_correlation_of_constants_is_zero(spark):
    rows = spark.createDataFrame([("x", 1.0, 1.0), ("x", 1.0, 2.0), ("y", 1.0, 2.0), ("y", 2.0, 4.0)], "song_id string, a double, b double")
    assert {r["song_id"]: round(r["r"], 6) for r in ops.correlation(rows).collect()} == {"x": 0.0, "y": 1.0}


def test_quality_gate(spark):
    rows = spark.createDataFrame(
        [("up", (0.6, 0.3, 1.0, 0.1), (0.8, 0.5, 0.9, 0.1)), ("harm", (0.6, 0.3, 1.0, 0.1), (0.5, 0.9, 0.9, 0.1)), ("clicks", (0.6, 0.3, 1.0, 0.1), (0.8, 0.5, 0.9, 0.5))],
        "target string, base struct<chroma:double,onset:double,log_mel:double,boundary:double>, other struct<chroma:double,onset:double,log_mel:double,boundary:double>",
    )
    assert {r["target"]: r["accepted"] for r in measures.choose_renderer(rows).collect()} == {"up": True, "harm": False, "clicks": False}


@pytest.mark.parametrize(
    ("url", "ok", "video"),
    [
        ("https://www.youtube.com/watch?v=dQw4w9WgXcQ", True, "dQw4w9WgXcQ"),
        ("youtu.be/abc_123-x?t=3", True, "abc_123-x"),
        ("https://m.youtube.com/shorts/abcdefg/", True, "abcdefg"),
        ("http://127.0.0.1/secret", False, None),
        ("https://evil.com/?u=youtube.com", False, None),
        ("https://youtube.com@evil.com/watch?v=abcdefg", False, None),
        ("", False, None),
        (None, False, None),
    ],
)
def test_links(spark, url, ok, video):
    r = spark.createDataFrame([(url,)], "u string").select(urls.is_allowed(F.col("u")).alias("ok"), urls.video_id(F.col("u")).alias("v")).first()
    assert (r["ok"], r["v"]) == (ok, video)


def test_shifts_fold(spark):
    rows = spark.createDataFrame([(float(s),) for s in (-30, -6, 6, 7, 18, 1, 2)], "s double")
    got = [r[0] for r in rows.select(costs.fold_shift(F.col("s"), F.lit("full"))).collect()]
    assert got == [-6.0, -6.0, 6.0, -5.0, 6.0, 1.0, 2.0]
    assert rows.where("s = 1").select(costs.fold_shift(F.col("s"), F.lit("drums"))).first()[0] == 0.35


def test_equal_power(spark):
    r = spark.range(8).select(costs.fade_in(F.col("id"), F.lit(8)).alias("a"), F.cos(F.pi() / 2 * F.col("id") / 8).alias("b")).collect()
    assert all(math.isclose(x["a"] ** 2 + x["b"] ** 2, 1) for x in r)
