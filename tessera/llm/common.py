"""What the operators share: words, hashes, windows, and tables written to the shared folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
CHUNK_BYTES = 2 << 20  # text that a Python worker takes apart at once


# ---------------------------------------------------------------- tables in the shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a new local one in local mode (tests); on a cluster an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(spark, "_tessera_dir", None):
        spark._tessera_dir = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return spark._tessera_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and returns the written table: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def settle(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of steps whose result has been written; they would else stay until the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Deletes a table that materialize() wrote and nothing reads any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of so many rows at most: whole texts of a batch are in a Python worker at once. A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = int(spark.conf.get(name))
    if was <= 0 or was > rows:
        spark.conf.set(name, str(rows))


# ---------------------------------------------------------------- groups of any size

SALTS = 32  # tasks that a group of any size is dealt over


def with_group(rows: DataFrame, keys: list[str], spread: str, facts: list[Column], where: str | None = None, also: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows, each with facts of its group (aggregates that combine before the shuffle); groups that fail `where` are left out.

    A group's rows are dealt over SALTS parts by a hash of `spread`, and its facts are joined to the parts that it has: there
    are never more of these than rows, and a hot group is no one task's. `also` may add columns to the table of groups. Null
    keys are left out.
    """
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    groups = rows.groupBy(*keys).agg(*facts, F.bit_or(F.expr("shiftleft(1L, _part)")).alias("_parts"))
    if where:
        groups = groups.where(where)
    if also:
        groups = also(groups)
    every = ", ".join(str(i) for i in range(SALTS))
    groups = groups.withColumn("_part", F.explode(F.expr(f"filter(array({every}), i -> (shiftright(_parts, i) & 1L) = 1L)"))).drop("_parts")
    return rows.hint("merge").join(groups, [*keys, "_part"]).drop("_part")


# ---------------------------------------------------------------- texts in Arrow batches


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The column's texts as UTF-8 bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).to_pylist()


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """(doc_ids, texts as bytes; null: empty) of about `limit` bytes, from batches with doc_id and text. A longer text comes alone."""
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))
        at, size = 0, 0
        for i, t in enumerate(texts):
            n = len(t) if t else 0
            if size and size + n > limit:
                yield ids[at:i], [t or b"" for t in texts[at:i]]
                at, size = i, 0
            size += n
        if at < len(ids):
            yield ids[at:], [t or b"" for t in texts[at:]]


def split_words(text: bytes) -> list[bytes]:
    """The matches of [^\\x20\\x09-\\x0D]+ in UTF-8 bytes: bytes.split() splits on exactly these six characters."""
    return text.split()


# ---------------------------------------------------------------- hashes


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, one after another, and the offset of each text (one more than texts)."""
    parts, offsets = [], np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        words = t.split()
        offsets[i + 1] = offsets[i] + len(words)
        if words:
            parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher: a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(units: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomial hash (mod 2^64, odd base) of every k consecutive units, by doubling: log2(k) passes."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have = None, 0
    cur, size, power = units, 1, base & (2**64 - 1)
    rest = k
    while rest:
        if rest & 1:
            if out is None:
                out = cur[:]
            else:  # out covers `have` units, cur the next `size`
                m = min(len(out), len(cur) - have)
                out = out[:m] * np.uint64(power) + cur[have : have + m]
            have += size
        rest >>= 1
        if rest:
            m = len(cur) - size
            cur = cur[:m] * np.uint64(power) + cur[size : size + m]
            power = power * power & (2**64 - 1)
            size *= 2
    return mix(out[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    if size < w:
        d = w - size
        x = np.minimum(x[:-d], x[d:])
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sorted_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Deals df out by keys, sorted by them within tasks, for grouped_batches()."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def grouped_batches(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a sorted stream of batches, one after another; only one is kept. Cheaper than a Python call for each group."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        first = tuple(c[0] for c in cols)
        if kept and first != last:
            yield pa.Table.from_batches(kept)
            kept = []
        for a, b in zip(starts[:-1], starts[1:]):
            if a and kept:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if kept:
        yield pa.Table.from_batches(kept)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """A sorted stream of batches as tables of whole groups, many in each; for groups of bounded size."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        if kept and kept[-1].column(key)[-1].as_py() != values[0]:
            yield pa.Table.from_batches(kept)
            kept = []
        change = np.flatnonzero(values[1:] != values[:-1])
        if len(change):
            last = int(change[-1]) + 1
            yield pa.Table.from_batches([*kept, batch.slice(0, last)])
            kept = [batch.slice(last)]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)
