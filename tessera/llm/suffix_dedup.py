"""Removal of byte strings that occur earlier, with common prefixes from Burrows-Wheeler transforms of candidate text.

1. Every window of `length` bytes is shown by an anchor (winnow). Anchors that occur twice or more keep their runs of windows.
2. Equal runs are one text, held by the earliest. Different texts with one anchor go into shards of bounded size.
3. In a shard the suffixes are sorted and the transform gives each suffix's next one. Boundaries between suffixes are found
   breadth-first by common-prefix length: at each length a boundary appears where first bytes differ or where the intervals
   of the next suffixes have been parted at the length before. It stops at `length`: what is in one interval then is equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, grouped_batches, materialize, mix, settle, signed, small_batches, sorted_groups, text_bytes, text_chunks, window_hashes
from .winnow import runs, union_spans

LENGTH = 100
GRAM = 24  # bytes of an anchor
SHARD_BYTES = 3 << 17  # candidate text in a shard, about: what sorts and gathers of a core's cache can hold
TEXTS = 2000  # different texts of one anchor in a shard at most, about; beyond, shards are matched by hashes too
CHUNK = 1 << 19
END = 0xFF  # no byte of UTF-8
OWN = 0x9FB21C651E98DF25
UNITS = mix(np.arange(1, 257, dtype=np.uint64))  # each byte's hash


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their next `depth` bytes or more (ties in any order), by doubling from eight bytes."""
    n = len(text)
    rank = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for bits in (8, 16, 32):
        rank = (rank[: -(bits // 8)] << np.uint64(bits)) | rank[bits // 8 :]
    rank = rank[:n]
    order = np.argsort(rank)
    reach = 8
    while True:
        own = rank[order]
        number = np.empty(n, np.uint64)
        new = np.ones(n, bool)
        new[1:] = own[1:] != own[:-1]
        dense = np.cumsum(new, dtype=np.int32)
        number[order] = dense
        if reach >= depth or dense[-1] == n:
            return order
        number <<= np.uint64(32)
        number[: n - reach] |= number[reach:] >> np.uint64(32)
        rank = number
        order = np.argsort(rank)
        reach *= 2


def equal_intervals(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, interval number of each in that order): one interval holds the suffixes with the same first `length` bytes."""
    n = len(text)
    order = suffix_order(text, length)
    bwt = text[order - 1]  # the byte before each suffix (of the first: the last)
    # rows by their transform's byte, in order, are the rows of the suffixes one byte longer: the inverse leads to the next suffix
    forward = np.argsort(bwt, kind="stable").astype(np.int32)  # forward[i]: row of the suffix after that of row i
    first = text[order]
    edge = np.ones(n, bool)
    edge[1:] = first[1:] != first[:-1]
    open_ = np.flatnonzero(~edge).astype(np.int32)
    here, before = forward[open_], forward[open_ - 1]
    group = np.empty(n, np.int32)
    for _ in range(1, length):  # at the start, edges are those of common prefixes below this value
        if not len(open_):
            break
        np.cumsum(edge, out=group)
        parted = group[here] != group[before]
        if not parted.any():
            break  # nothing parts any further
        edge[open_[parted]] = True
        still = ~parted
        open_, here, before = open_[still], here[still], before[still]
    return order, np.cumsum(edge, dtype=np.int32) - 1


RUNS = "doc_id long, start long, count int, key long, variant long"


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, list]]:
    for batch in batches:
        keys = batch.column("keys").to_pylist() if "keys" in batch.schema.names else [None] * batch.num_rows
        at = 0
        for ids, texts in text_chunks(iter([batch]), CHUNK):
            units = UNITS[np.frombuffer(b"".join(texts), np.uint8)]
            yield ids, units, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), keys[at : at + len(ids)]
            at += len(ids)


def _anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for ids, units, offsets, _ in _bounded(batches):
        r = runs(units, offsets, length, gram)
        if len(r.key):
            order = np.lexsort((r.key, r.text))
            key, text = r.key[order], r.text[order]
            at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(signed(key[at])), pa.array(np.array(ids, np.int64)[text[at]]), pa.array(np.diff(np.append(at, len(key))))], names=["key", "doc_id", "n"])


def _runs(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Runs on repeated anchors, with a hash of all their bytes."""
    for ids, units, offsets, keys in _bounded(batches):
        r = runs(units, offsets, length, gram)
        wanted = np.unique(np.array([k for own in keys for k in own or ()], np.int64))
        pick = np.flatnonzero(np.isin(signed(r.key), wanted))
        if len(pick):
            own = window_hashes(units, length, OWN)
            flat, count = r.flat[pick], r.count[pick]
            total = mix(own[flat] + mix(own[flat + count - 1] + mix(count.astype(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[r.text[pick]]), pa.array(r.start[pick]), pa.array(count.astype(np.int32)), pa.array(signed(r.key[pick])), pa.array(signed(total))], names=[c.split()[0] for c in RUNS.split(", ")])


TEXT_ROWS = "shard long, shards long, key long, variant long, doc_id long, start long, bytes binary"


def _cut_texts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs that a document is the first to have."""
    for batch in batches:
        rows = [(*(c[k] for k in ("shard", "shards", "key", "variant")), i, c["start"], t[c["start"] : c["start"] + c["count"] - 1 + length]) for i, t, own in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), batch.column("cuts").to_pylist()) for c in own]
        if rows:
            kinds = (*[pa.int64()] * 6, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in TEXT_ROWS.split(", ")])


LATE = "key long, variant long, lo array<int>, hi array<int>, hashes array<long>"


def _late(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """For each text of a shard, the windows that an earlier text of the shard has; where an anchor has more shards, the others' hashes."""
    for group in grouped_batches(batches, ["shard"]):
        # a repeated row of a document cuts the same text again
        key, variant = (group.column(c).to_numpy() for c in ("key", "variant"))
        order = np.lexsort((variant, key))
        new = np.append(True, (key[order][1:] != key[order][:-1]) | (variant[order][1:] != variant[order][:-1]))
        if not new.all():
            group = group.take(pa.array(np.sort(order[new])))
        texts = group.column("bytes").to_pylist()
        doc, start = group.column("doc_id").to_numpy(), group.column("start").to_numpy()
        more = group.column("shards").to_numpy() > 1
        text = np.frombuffer(bytes([END]).join(texts) + bytes([END]), np.uint8)
        size = np.array([len(t) for t in texts])
        first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        windows = size - length + 1
        order, interval = equal_intervals(text, length)
        of = np.empty(len(text), np.int64)
        of[order] = interval
        row = np.repeat(np.arange(len(texts)), windows)
        place = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        mine = of[first[row] + place]
        by = np.lexsort((start[row] + place, doc[row], mine))
        lead = np.append(True, mine[by][1:] != mine[by][:-1])
        late = np.ones(len(row), bool)
        late[by[lead]] = False
        hashes = signed(window_hashes(UNITS[text], length, OWN)) if more.any() else None
        # stretches of late windows, each within its text
        begins = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
        ends = np.append(begins[1:], True) if len(row) else begins
        up = np.flatnonzero(late & (begins | ~np.append(False, late[:-1])))
        down = np.flatnonzero(late & (ends | ~np.append(late[1:], False)))
        at = np.concatenate([[0], np.cumsum(np.bincount(row[up], minlength=len(texts)))]).astype(np.int32)
        lo, hi = (pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))) for x in (place[up], place[down] + 1))
        out_hash = pa.array([hashes[f : f + n].tolist() if m else None for f, n, m in zip(first.tolist(), windows.tolist(), more.tolist())] if more.any() else [None] * len(texts), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([group.column("key").combine_chunks(), group.column("variant").combine_chunks(), lo, hi, out_hash], names=["key", "variant", "lo", "hi", "hashes"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        cuts = batch.column("cuts")
        a, b = (cuts.values.field(k).to_numpy(zero_copy_only=False) for k in ("a", "b"))
        ends = cuts.offsets.to_numpy()
        for text, some, x, y in zip(text_bytes(batch.column("text")), cuts.is_valid().to_pylist(), ends.tolist(), ends[1:].tolist()):
            text = text or b""
            spans = union_spans(a[x:y], b[x:y]) if some else []
            kept, at = [], 0
            for lo, hi in spans:
                kept.append(text[at:lo])
                at = hi
            left = b"".join([*kept, text[at:]])
            rows.append((len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, a, b): bytes a to b (exclusive) that strings of `length` bytes cover which also start earlier."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text").where("text is not null and doc_id is not null")
    anchors = materialize(docs.mapInArrow(lambda b: _anchors(b, length, gram), "key long, doc_id long, n long"), "anchors")
    repeated = anchors.groupBy("key").agg(F.sum("n").alias("all")).where("all > 1").select("key")
    wanted = materialize(anchors.join(repeated, "key").groupBy("doc_id").agg(F.collect_list("key").alias("keys")), "wanted")
    discard(anchors)
    settle(spark)
    found = materialize(docs.hint("merge").join(wanted, "doc_id").mapInArrow(lambda b: _runs(b, length, gram), RUNS), "runs")
    discard(wanted)
    settle(spark)
    texts = found.groupBy("key", "variant").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.first("count").alias("count"))
    texts = materialize(texts.select("key", "variant", F.col("first.doc_id").alias("doc"), F.col("first.start").alias("at"), "count"), "texts")
    several = texts.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("count") + length).alias("size")).where("n > 1")
    several = materialize(several.withColumn("shards", F.ceil(F.col("n") / TEXTS)), "several")
    size = several.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    sub = F.when(F.col("shards") > 1, F.pmod(F.xxhash64("variant"), F.col("shards"))).otherwise(F.lit(0))
    cuts = texts.join(several.select("key", "shards"), "key").withColumn("shard", F.pmod(F.xxhash64("key", sub), F.lit(shards)))
    cuts = cuts.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("shard", "shards", "key", "variant", F.col("at").alias("start"), "count")).alias("cuts"))
    rows = docs.hint("merge").join(cuts, "doc_id").mapInArrow(lambda b: _cut_texts(b, length), TEXT_ROWS)
    late = materialize(sorted_groups(rows, ["shard"]).mapInArrow(lambda b: _late(b, length), LATE), "late")
    settle(spark)
    # anchors with several shards: the earliest of each hash holds it
    spread = late.where("hashes is not null").join(texts, ["key", "variant"]).select("key", "variant", "doc", "at", F.posexplode("hashes").alias("place", "hash"))
    spread = spread.withColumn("own", F.struct("doc", (F.col("at") + F.col("place")).alias("at")))
    least = spread.groupBy("key", "hash").agg(F.min("own").alias("least"))
    across = spread.join(least, ["key", "hash"]).where("own <> least").groupBy("key", "variant").agg(F.collect_list("place").alias("across"))
    own = late.where("size(lo) > 0").select("key", "variant", F.inline(F.arrays_zip("lo", "hi")))
    own = own.unionAll(across.select("key", "variant", F.explode("across").alias("lo")).select("key", "variant", "lo", (F.col("lo") + 1).alias("hi")))
    own = own.groupBy("key", "variant").agg(F.collect_list(F.struct("lo", "hi")).alias("late"))
    known = materialize(texts.select("key", "variant", "doc", "at").join(own, ["key", "variant"], "left"), "known")
    placed = found.join(known, ["key", "variant"])
    whole = placed.where("doc_id <> doc or start <> at").select("doc_id", F.col("start").alias("a"), (F.col("start") + F.col("count") - 1 + length).alias("b"))
    part = placed.where("doc_id = doc and start = at and late is not null").select("doc_id", "start", F.inline("late"))
    return whole.unionAll(part.select("doc_id", (F.col("start") + F.col("lo")).alias("a"), (F.col("start") + F.col("hi") - 1 + length).alias("b")))


def dedup_suffixes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (bytes).

    Texts are UTF-8 bytes (null: empty), matches never cross documents. Each byte goes that a `length`-byte string covers which also
    starts earlier: in a document of smaller doc_id, or before in the same one; strings are judged on the input. doc_id is a
    key: rows that repeat a document are one in judging, and each gets its result. Rows of null doc_id keep all and take
    nothing from others. Shorter texts keep all. Extra columns are not read; an empty table gives no rows.
    """
    spans = materialize(repeated_bytes(docs, length, gram), "spans")
    settle(docs.sparkSession)
    cuts = spans.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("cuts"))
    return docs.select("doc_id", "text").hint("merge").join(cuts, "doc_id", "left").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


# the same for keyed documents in DuckDB: every string by its 128-bit digest
SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, i, md5_number(substring(h, 2 * i + 1, {2 * LENGTH})) AS key FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS i FROM d WHERE len(h) >= {2 * LENGTH})),
c AS (SELECT doc_id, i FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, i) > 1),
m AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 1 ELSE 0 END AS new FROM c),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
s AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM g GROUP BY doc_id, run),
p AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s),
t AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last FROM s GROUP BY doc_id),
x AS (SELECT doc_id, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN last IS NULL THEN h ELSE head || substring(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN x USING (doc_id)
"""
