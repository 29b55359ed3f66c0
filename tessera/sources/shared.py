"""Tables that an operator writes between its steps: in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new local folder in local mode, and an error on a cluster."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if getattr(spark, "_tessera_tables", None) is None:
        spark._tessera_tables = "file://" + tempfile.mkdtemp(prefix="tessera-tables-")
    return spark._tessera_tables


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table: its rows stay what they are, however often they are read."""
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
