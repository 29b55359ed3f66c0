"""Results as JSON documents, one a target: written, and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "target string, songs array<string>, stats struct<tiles: bigint, transitions: bigint, similarity: double>, tiles array<struct<t: bigint, source_id: bigint, song_id: string, key_shift: int, score: double, layers: array<struct<source_id: bigint, song_id: string, weight: double>>>>, render struct<backend: string, quality: struct<chroma: double, onset: double, log_mel: double, boundary: double>>"


def _rounded(x: Column | str) -> Column:
    """x to four places as SQL rounds it: by its product with 10,000. Scores have six places, so ties occur, and Spark's own round goes by the decimals that print."""
    return F.round((F.col(x) if isinstance(x, str) else x) * 10000) / 10000


def documents(tiles: DataFrame, layers: DataFrame) -> DataFrame:
    """(target, document): tiles (target, t, source_id, song_id, key_shift, score) with their layers and a few figures."""
    own = layers.groupBy("target", "t").agg(F.array_sort(F.collect_list(F.struct("layer", "source_id", "song_id", _rounded("weight").alias("weight")))).alias("l"))
    rows = tiles.join(own, ["target", "t"], "left").withColumn("layers", F.transform("l", lambda x: F.struct(x["source_id"].alias("source_id"), x["song_id"].alias("song_id"), x["weight"].alias("weight"))))
    tile = F.struct("t", "source_id", "song_id", F.col("key_shift").cast("int").alias("key_shift"), _rounded("score").alias("score"), "layers")
    out = rows.groupBy("target").agg(F.array_sort(F.collect_list(tile)).alias("tiles"), F.array_sort(F.collect_set("song_id")).alias("songs"), F.count("*").alias("n"), _rounded(F.avg("score")).alias("mean"))
    change = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size("tiles") - 1, F.lit(1))), lambda i: F.get("tiles", i)["song_id"] != F.get("tiles", i - 1)["song_id"]))
    stats = F.struct(F.col("n").alias("tiles"), change.cast("long").alias("transitions"), F.col("mean").alias("similarity"))
    return out.select("target", F.to_json(F.struct("target", "songs", stats.alias("stats"), "tiles")).alias("document"))


def write_documents(docs: DataFrame, path: str) -> None:
    docs.select("document").write.text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents again as rows of nested columns; lines that are none: see broken_lines()."""
    return _parsed(spark, path).where("d.target is not null").select("d.*")


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of what read_documents() leaves out."""
    return _parsed(spark, path).where("d.target is null").select(F.col("value").alias("line"))


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.from_json("value", DOCUMENT).alias("d"))
