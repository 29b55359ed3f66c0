from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the tables are not here")


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == columns, name
        out = out.cache()
        assert 0 < out.count() <= n, name
        n, docs = out.count(), out
    whole = corpus_pipeline.run(spark, DATA).toPandas()
    assert set(whole["doc_id"]) == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_run_equals_brute_force(spark):
    """Stages 2 and 3 again by plain loops from stage 1's rows; stage 4 by whole items; then the packed documents and their token counts."""
    from test_dedup import brute_classes

    from tessera.llm.queries import tokenizer_path
    from tessera.llm.tokens import WordTokens

    start = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
    rows = sorted((r["doc_id"], r["text"]) for r in start.select("doc_id", "text").collect())
    classes = brute_classes(rows)
    rows = [r for r in rows if classes[r[0]][1] == r[0]]
    first, kept = {}, {}
    for i, text in rows:
        w = (text or "").encode().split()
        own, gone = set(), bytearray(len(w))
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            own.add(k)
            if k in first:
                gone[j : j + 50] = b"\1" * 50
        for k in own:
            first.setdefault(k, i)
        if not w or not all(gone):
            kept[i] = b" ".join(x for x, g in zip(w, gone) if not g) if any(gone) else (text or "").encode()
    items = [" ".join((r["text"] or "").lower().split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not any(x and f" {x} " in f" {' '.join(t.decode().lower().split())} " for x in items)}
    tokens = WordTokens(tokenizer_path())
    want = {i: len(tokens.encode([t])[0]) + 1 for i, t in kept.items()}
    got = corpus_pipeline.run(spark, DATA).toPandas().groupby("doc_id")["length"].sum().to_dict()
    assert got == want


def test_null_ids_and_repeated_rows(spark):
    """Rows of null doc_id are documents like others, and a document's repeated rows stay as many."""
    import random

    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choice("abcdefghi") for _ in range(6)) for _ in range(n))
    clean, copied, twice, shared, repeated, other = text(80), text(80), text(80), text(60), text(90), text(90)
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    rows = [(None, clean), (1, copied), (None, copied), (None, twice), (None, twice), (2, shared + " " + other), (None, shared + " " + text(90)), (3, repeated), (3, repeated), (None, text(50) + " " + item + " " + text(50)), (4, shared + " " + text(30))]
    rows.append(rows[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "length(text) n_chars")
    key = lambda df: sorted((-1 if x["doc_id"] is None else x["doc_id"], x["text"]) for x in df.collect())
    tail = rows[6][1].split()[60:], rows[10][1].split()[60:]
    one = corpus_pipeline.keep_one_of_near_copies(spark, docs, DATA).cache()
    want = [(-1 if i is None else i, t) for i, t in (rows[0], rows[1], rows[3], rows[5], rows[6], rows[7], rows[8], rows[9], rows[10], rows[11])]
    assert key(one) == sorted(want)
    two = corpus_pipeline.cut_repeated_passages(spark, one, DATA).cache()
    want[4] = (-1, " ".join(tail[0]))
    want[8] = want[9] = (4, " ".join(tail[1]))
    assert key(two) == sorted(want)
    three = corpus_pipeline.drop_contaminated(spark, two, DATA)
    assert key(three) == sorted(x for x in want if item not in x[1])


def test_columns_of_any_name_pass(spark):
    """Columns called like the stages' own ones keep their values, in every stage."""
    names = ["toxic", "toxicity", "n_words", "n_removed", "kept_text", "kept_sha256", "component_id", "again", "_column_1", "n_chars", "item_id", "a.b"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    docs = docs.select("doc_id", "text", *((F.col("doc_id") + i).alias(n) for i, n in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == r["doc_id"] + i for r in rows for i, n in enumerate(names) if n != "n_chars"), name
    assert corpus_pipeline.pack_sequences(spark, docs, DATA).count() >= 200
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as driver

    names = set(driver.queries())
    assert {"pipeline"} <= names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
