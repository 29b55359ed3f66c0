"""The corpus pipeline: each stage writes its result, and the next one reads it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.decontamination import find_leaks
from tessera.llm.jaccard_join import jaccard_classes
from tessera.llm.packing import pack
from tessera.llm.queries import table, tokenizer_path
from tessera.llm.substring_dedup import dedup_substrings
from tessera.llm.toxicity import score_toxicity, train_on

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _all_named(docs: DataFrame) -> tuple[DataFrame, int]:
    """The documents, those of null doc_id with numbers of their own from the one returned on; no other doc_id reaches it."""
    top = docs.agg(F.max("doc_id")).first()[0]
    first = 0 if top is None else top + 1
    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return docs, first
    # written, so that the numbers stay
    named = materialize(nameless.withColumn("doc_id", F.lit(first).cast("long") + F.monotonically_increasing_id()), "named")
    return docs.where("doc_id is not null").unionByName(named), first


def _as_before(docs: DataFrame, first: int) -> DataFrame:
    return docs.withColumn("doc_id", F.when(F.col("doc_id") < first, F.col("doc_id")))


OWN = ("doc_id", "text", "n_chars")


def any_columns(stage: Stage) -> Stage:
    """The stage, with columns of any name: all but OWN go by names that no stage uses, and come back as they were."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in OWN else f"_column_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).toDF(*docs.columns)

    return run_stage


@any_columns
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.5, with all their columns, whatever they are called.

    Null and empty texts are scored like others; rows of null doc_id are scored but not learnt from; repeated rows are judged alike.
    Without labels nothing is toxic. An empty table stays empty.
    """
    model = train_on(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).where("toxic = 0").select(*docs.columns)


@any_columns
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents, the one with the smallest doc_id; null ones come last, each row by itself.

    Documents without words (null text among them) link with nothing and stay; repeated rows of a document that stays all stay. Other
    columns are not read. An empty table stays empty.
    """
    named, first = _all_named(docs)
    kept = jaccard_classes(named).where("component_id = doc_id").select("doc_id")
    return _as_before(named.join(kept, "doc_id", "left_semi"), first).select(*docs.columns)


@any_columns
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that a document of smaller doc_id has; documents left without words go.

    A text that loses nothing stays as it is; of others the kept words are joined by blanks. Rows of null doc_id come last, each
    by itself; rows that repeat a document stay as many.
    """
    named, first = _all_named(docs)
    cut = dedup_substrings(named).select("doc_id", "n_words", "n_removed", "kept_text")
    # one row for each document; the window streams over the join's own order
    again = F.lag(F.lit(True)).over(Window.partitionBy("doc_id").orderBy("doc_id"))
    cut = cut.withColumn("again", again).where("again is null").drop("again")
    rows = named.join(cut, "doc_id").where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return _as_before(rows.select(*(changed.get(c, F.col(c)).alias(c) for c in docs.columns)), first)


@any_columns
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null texts hold none and stay, as do all documents when the benchmark is empty.

    Rows of null doc_id are judged each by itself, repeated rows alike. Other columns are not read.
    """
    named, first = _all_named(docs)
    leaks = find_leaks(named, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return _as_before(named.join(leaks, "doc_id", "left_anti"), first).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' tokens in training sequences; null and empty texts are one token long, repeated rows are packed again.

    Other columns are not read; an empty table gives no rows.
    """
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_copies", keep_one_of_near_copies),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # no stage but the last joins can be said in SQL; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
