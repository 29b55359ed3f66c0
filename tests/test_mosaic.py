"""Documents, options, candidates."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions.arrays import clock, fit_length, window_at
from tessera.functions.costs import MatchParams
from tessera.operators import factorize, mosaic
from tessera.sources import documents


def test_options_are_checked():
    mosaic.checked(MatchParams(), 0.45)
    for p in (MatchParams(top_k=0), MatchParams(max_share=1.5), MatchParams(n_layers=0)):
        with pytest.raises(ValueError):
            mosaic.checked(p)
    with pytest.raises(ValueError):
        mosaic.checked(MatchParams(hop_s=0.5), 0.45)


def test_documents_round_trip(spark, tmp_path):
    tiles = spark.createDataFrame([("T5", 1, 7, "A", 2, 0.91234), ("T5", 2, 8, "B", 0, 0.5)], "target string, t long, source_id long, song_id string, key_shift int, score double")
    layers = spark.createDataFrame([("T5", 1, 0, 7, "A", 0.62), ("T5", 1, 1, 8, "B", 0.38), ("T5", 2, 0, 8, "B", 1.0)], "target string, t long, layer long, source_id long, song_id string, weight double")
    docs = documents.documents(tiles, layers)
    d = json.loads(docs.first()["document"])
    assert d["stats"] == {"tiles": 2, "transitions": 1, "similarity": 0.7062} and d["songs"] == ["A", "B"] and len(d["tiles"][0]["layers"]) == 2
    documents.write_documents(docs, str(tmp_path / "out"))
    assert documents.read_documents(spark, str(tmp_path / "out")).first()["tiles"][1]["song_id"] == "B"


def test_documents_round_ties_as_sql_does(spark):
    import duckdb

    scores = [0.80995, 0.00115, 0.5, 0.12345, *(n / 1000000 for n in range(50, 100000, 1700))]
    tiles = spark.createDataFrame([("T5", n, n, "A", 0, x) for n, x in enumerate(scores)], "target string, t long, source_id long, song_id string, key_shift int, score double")
    layers = tiles.selectExpr("target", "t", "0L AS layer", "source_id", "song_id", "score AS weight")
    d = json.loads(documents.documents(tiles, layers).first()["document"])
    wanted = duckdb.execute("SELECT list_transform(?::DOUBLE[], lambda x: round(x, 4))", [scores]).fetchone()[0]
    assert [x["score"] for x in d["tiles"]] == [x["layers"][0]["weight"] for x in d["tiles"]] == wanted


def test_candidates_are_distinct_until_they_repeat(spark):
    scored = spark.createDataFrame([("T5", 1, i, "AB"[i % 2], 1 - i / 100) for i in range(6)], "target string, t long, source_id long, song_id string, score double")
    atoms = spark.createDataFrame([(i, "AB"[i % 2], i // 2) for i in range(10)], "source_id long, song_id string, frame long")
    got = [r["source_id"] for r in factorize.candidate_beam(scored, atoms, 8).orderBy("slot").collect()]
    assert got == [0, 1, 2, 3] * 2
    few = [r["source_id"] for r in factorize.candidate_beam(scored.where("source_id < 2"), atoms.where("source_id < 2"), 8).orderBy("slot").collect()]
    assert few == [0, 1] * 4


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    r = df.select(fit_length("x", 5).alias("long"), fit_length("x", 2).alias("short"), window_at("x", F.lit(2), 3).alias("w"), window_at("x", F.lit(3), 3).alias("none"), clock(F.lit(75.9)).alias("c")).first()
    assert (r["long"], r["short"], r["w"], r["none"], r["c"]) == ([1, 2, 3, 0, 0], [1, 2], [3, 0, 0], None, "1:15")
