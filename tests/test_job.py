"""Measures by blocks against whole-sound kernels, and the whole job on tones."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.functions.costs import MatchParams
from tessera.operators import job, quality, render
from tessera.sources import catalog, documents

SR = 8000


def waves(spark, songs, block=1024):
    rows = [(s, "song", 0, [float(v) for v in y]) for s, y in songs.items() if len(y)]
    return render.wave_blocks(spark.createDataFrame(rows, "song_id string, kind string, piece long, samples array<double>"), block)


def plain_boundary(y, places):
    jumps = [abs(y[i] - y[i - 1]) / (np.sqrt((y * y).mean()) + 1e-6) for i in places if 1 <= i < len(y)]
    return float(np.median(jumps)) if jumps else 0.0


def test_measures_equal_whole_sound_kernels(spark, monkeypatch):
    monkeypatch.setattr(quality, "FRAMES", 5)  # many blocks
    r = np.random.default_rng(2)
    t = np.arange(3 * SR) / SR
    ref = {"a": 0.3 * np.sin(2 * np.pi * 440 * t) * (t % 0.5), "b": r.normal(0, 0.2, 9000), "c": np.zeros(5000), "d": r.normal(0, 1, 40), "e": r.normal(0, 1, 3000), "same": r.normal(0, 0.1, 7000)}
    est = {"a": 0.25 * np.sin(2 * np.pi * 523.25 * t[:20000]) * (t[:20000] % 0.4), "b": r.normal(0, 0.1, 12000), "c": r.normal(0, 0.1, 5000), "d": r.normal(0, 1, 40), "same": ref["same"]}
    places = {"a": [0, 500, 1024, 4000, 25000], "b": [1023, 1024, 1025], "c": [], "same": [1]}
    df = spark.createDataFrame([(s, p) for s, ps in places.items() for p in ps], "target string, at long")
    got = {x["target"]: x for x in quality.compared(waves(spark, ref), waves(spark, est), SR, df, 1024).collect()}
    assert set(got) == set(ref)
    for s, y in ref.items():
        z = est.get(s, np.zeros(0))
        want = (kernels.log_mel_distance(y, z, SR), kernels.frame_chroma_similarity(y, z, SR), kernels.onset_correlation(y, z, SR), plain_boundary(z, places.get(s, [])))
        np.testing.assert_allclose([got[s][c] for c in ("log_mel", "chroma", "onset", "boundary")], want, atol=6e-5, err_msg=s)
    assert got["same"]["log_mel"] == 0 and got["same"]["chroma"] == 1 and got["same"]["onset"] == 1


def test_samples_as_waves(spark):
    df = spark.createDataFrame([("T", 0, 1.0), ("T", 3, 2.0), ("T", 9, 3.0), ("U", 2, 4.0)], "target string, at long, y double")
    got = {(r["song_id"], r["block"]): r["samples"] for r in job.as_waves(df, 4).collect()}
    assert got == {("T", 0): [1.0, 0.0, 0.0, 2.0], ("T", 2): [0.0, 3.0], ("U", 0): [0.0, 0.0, 4.0]}


@pytest.fixture(scope="module")
def setting(spark):
    """Tables of the smallest set: descriptors, and waves that are the vectors themselves."""
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 160")
    song = F.when(F.col("label") < 5, F.chr(F.col("label") + 65)).otherwise(F.concat(F.lit("T"), F.col("label").cast("string")))
    rows = e.select(song.alias("song_id"), F.lit("song").alias("kind"), F.col("vec_id").alias("piece"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    whole = render.wave_blocks(rows, 256).cache()
    return catalog.targets(e), catalog.sources(e), whole.where("song_id like 'T%'"), whole.where("song_id not like 'T%'")


@pytest.mark.parametrize("backend", ["auto", "unit", "nmf"])
def test_job_from_descriptors_to_documents(spark, setting, backend, tmp_path):
    targets, sources, goal, songs = setting
    p = job.JobParams(sr=291, size=128, hop=64, polyphony=3, backend=backend, block=256)
    out = job.run_job(targets, sources, goal, songs, p, MatchParams(top_k=6, n_layers=2))
    names = {r["song_id"] for r in targets.select("song_id").distinct().collect()}
    rows = {r["target"]: r for r in out.quality.collect()}
    assert set(rows) == names
    for r in rows.values():
        assert r["backend"] in ("unit", "nmf") and (backend == "auto" or r["backend"] == backend)
        assert (r["nmf"] is None) == (backend == "unit")
        assert all(0 <= r["unit"][c] <= 1 for c in ("chroma",)) and r["unit"]["log_mel"] >= 0
    sound = {r["song_id"] for r in out.sound.collect()}
    assert sound == names
    docs = {r["target"]: json.loads(r["document"]) for r in out.documents.collect()}
    n = {r["target"]: r["n"] for r in out.tiles.groupBy("target").agg(F.count("*").alias("n")).collect()}
    for t, d in docs.items():
        assert {"target", "songs", "stats", "tiles", "render"} <= set(d) and len(d["tiles"]) == d["stats"]["tiles"] == n[t]
        assert d["render"]["backend"] == rows[t]["backend"]
    path = str(tmp_path / "documents")
    documents.write_documents(out.documents, path)
    spark.createDataFrame([("not json",)], "document string").write.mode("append").text(path)
    back = {r["target"]: r for r in documents.read_documents(spark, path).collect()}
    assert {t: r["render"]["backend"] for t, r in back.items()} == {t: d["render"]["backend"] for t, d in docs.items()}
    assert {t: len(r["tiles"]) for t, r in back.items()} == n
    assert [r["line"] for r in documents.broken_lines(spark, path).collect()] == ["not json"]


def test_backends_are_checked(spark, setting):
    with pytest.raises(ValueError):
        job.run_job(*setting, job.JobParams(backend="other"))
