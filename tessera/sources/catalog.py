"""The tables, and how vectors and event streams are read as descriptors, segments and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import unit

HOP_S = 0.22
WINDOW_S = 0.45
SOURCES = ("A", "B", "C", "D", "E")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def descriptors(embeddings: DataFrame) -> DataFrame:
    """One row per vector: song_id, segment_idx, start_s, end_s, and unit-length descriptor blocks.

    Labels 0 to 4 are the sources A to E, others the targets T5, T6, ...; a song's segments follow vec_id.
    """
    e = F.transform("embedding", lambda x: x.cast("double"))
    raw = embeddings.where("embedding is not null").select(F.col("vec_id").alias("source_id"), "label", e.alias("e"))
    chroma = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: (F.abs(F.get("e", i - 1)) + F.abs(F.get("e", i + 11)) + F.abs(F.get("e", i + 23)) + F.abs(F.get("e", i + 35))) / 4)

    def block(a: int, n: int, positive: bool) -> F.Column:
        part = F.slice("e", a, n)
        return unit(F.transform(part, lambda x: F.abs(x)) if positive else part)

    w = Window.partitionBy("label").orderBy("source_id")
    song = F.when(F.col("label") < 5, F.chr(F.col("label") + 65)).otherwise(F.concat(F.lit("T"), F.col("label").cast("string")))
    out = raw.select(
        "source_id",
        "label",
        song.alias("song_id"),
        (F.row_number().over(w)).cast("long").alias("segment_idx"),
        unit(chroma).alias("chroma"),
        block(1, 48, True).alias("temporal"),
        block(49, 8, False).alias("timbre"),
        block(57, 4, True).alias("energy"),
        block(61, 3, True).alias("register"),
        F.least(F.lit(1.0), 4 * F.abs(F.get("e", F.lit(63)))).alias("level"),
    )
    start = F.lit(HOP_S) * (F.col("segment_idx") - 1)
    return out.withColumns({"start_s": start, "end_s": start + 0.12 + 0.05 * (F.col("source_id") % 7)})


def sources(embeddings: DataFrame) -> DataFrame:
    return descriptors(embeddings).where("label < 5")


def targets(embeddings: DataFrame) -> DataFrame:
    return descriptors(embeddings).where("label >= 5")


def signals(events: DataFrame) -> DataFrame:
    """Each user's events as a signal: song_id, i (from 0), y, t (seconds since the user's first event)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp_ltz"))
    rows = events.select(F.col("user_id").alias("song_id"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.col("value").cast("double").alias("y"), micros.alias("m"))
    return rows.withColumn("t", (F.col("m") - F.min("m").over(Window.partitionBy("song_id"))) / 1e6).drop("m")
