"""Cross-entropy difference: token losses by a target and a background bigram model that share one vocabulary.

The vocabulary is that of a public tokenizer file. Both models are of the same order and smoothing; the background counts all
documents, the target those of a given set. Counts are exact and distributed; each model's probability of a token after
another mixes its pair count with the token's own: (n(v, w) + MASS * p(w)) / (n(v) + MASS).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, settle, small_batches, text_chunks
from .tokens import word_tokens

MASS = 200.0
HELD_PAIRS = 8_000_000  # pairs of both models (24 bytes each) that go to every task at most; more are joined instead
COMBINE = 4_000_000  # keys that a counting task gathers before it adds them up

TOKENS = "doc_id long, target boolean, ids binary"


def _tokenized(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokens = word_tokens(path)
    for batch in batches:
        target, at = batch.column("target"), 0
        for ids, texts in text_chunks(iter([batch])):
            flat, offsets = tokens.encode(texts)
            rows = [flat[a:b].tobytes() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), target.slice(at, len(ids)), pa.array(rows, pa.binary())], names=["doc_id", "target", "ids"])
            at += len(ids)


def _keys(rows: list[bytes], start: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (previous << 16 | token) of all rows in turn, and each row's number of tokens; `start` precedes a row's first."""
    n = np.array([len(r) // 2 for r in rows], np.int64)
    ids = np.frombuffer(b"".join(rows), np.uint16).astype(np.int64)
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[(np.cumsum(n) - n)[n > 0]] = start
    return before << 16 | ids, n


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            yield part, part.column("ids").to_pylist()


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], *(np.add.reduceat(np.concatenate([p[i] for p in parts])[order], first) for i in (1, 2))


def _count(batches: Iterator[pa.RecordBatch], start: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for part, rows in _parts(batches):
        keys, n = _keys(rows, start)
        if not len(keys):
            continue
        target = np.repeat(part.column("target").to_numpy(zero_copy_only=False).astype(np.int64), n)
        order = np.argsort(keys, kind="stable")
        own = keys[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        held.append((own[first], np.diff(np.append(first, len(own))), np.add.reduceat(target[order], first)))
        size += len(first)
        if size > COMBINE:
            held = [_added(held)]
            size = len(held[0][0])
            if size > COMBINE // 2:  # mostly different: pass them on
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["pair", "background", "target"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _added(held)], names=["pair", "background", "target"])


class Singles:
    """What both models know of single tokens: bounded by the vocabulary. Totals of contexts, and smoothed shares."""

    def __init__(self, size: int, left: dict[int, tuple[int, int]], right: dict[int, tuple[int, int]]):
        self.after = np.zeros((2, size + 1))
        self.share = np.ones((2, size + 1))
        for i, n in left.items():
            self.after[:, i] = n
        for i, n in right.items():
            self.share[:, i] += n
        self.share /= self.share.sum(1, keepdims=True)

    def losses(self, pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Two losses (target, background) of each pair, in nats, with its two counts."""
        before, token = pairs >> 16, pairs & 0xFFFF
        return -np.log((counts + MASS * self.share[:, token]) / (self.after[:, before] + MASS))


SCORES = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"


def _scores(ids: list[int], n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    mean = sums / np.maximum(n, 1)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(mean[0]), pa.array(mean[1]), pa.array(mean[0] - mean[1])], names=[c.split()[0] for c in SCORES.split(", ")])


def _score_held(batches: Iterator[pa.RecordBatch], start: int, pairs: np.ndarray, counts: np.ndarray, singles: Singles) -> Iterator[pa.RecordBatch]:
    for part, rows in _parts(batches):
        keys, n = _keys(rows, start)
        own, back = np.unique(keys, return_inverse=True)
        found = np.zeros((2, len(own)))
        if len(pairs) and len(own):
            at = np.minimum(np.searchsorted(pairs, own), len(pairs) - 1)
            hit = pairs[at] == own
            found[:, hit] = counts[:, at[hit]]
        losses = singles.losses(own, found)[:, back]
        total = np.concatenate([np.zeros((2, 1)), losses.cumsum(1)], 1)
        ends = np.cumsum(n)
        yield _scores(part.column("doc_id").to_pylist(), n, total[:, ends] - total[:, ends - n])


def _pair_rows(batches: Iterator[pa.RecordBatch], start: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, pair, times) of each document."""
    for part, rows in _parts(batches):
        for i, r in zip(part.column("doc_id").to_pylist(), rows):
            own, times = np.unique(_keys([r], start)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i)), pa.array(own), pa.array(times)], names=["doc_id", "pair", "times"])


def _pair_losses(batches: Iterator[pa.RecordBatch], singles: Singles) -> Iterator[pa.RecordBatch]:
    for b in batches:
        losses = singles.losses(b.column("pair").to_numpy(), np.stack([b.column("target").to_numpy(), b.column("background").to_numpy()]).astype(float)) * b.column("times").to_numpy()
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("times"), pa.array(losses[0]), pa.array(losses[1])], names=["doc_id", "times", "t", "b"])


def score_documents(docs: DataFrame, targets: DataFrame, tokenizer_path: str, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_tokens, loss_target, loss_background (nats a token), score = their difference (lower: more like the targets).

    targets: doc_ids of the target set (repeated ones count once). Null or empty texts have no tokens, and zeros. doc_id is a
    key. Without targets the target model is uniform but for the vocabulary. Extra columns are not read; an empty table gives
    no rows. Models of more than `held_pairs` pairs are not sent to the tasks but joined, with the same result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    start = word_tokens(tokenizer_path).size
    chosen = targets.select("doc_id").where("doc_id is not null").distinct().withColumn("target", F.lit(True))
    rows = docs.select("doc_id", "text").hint("merge").join(chosen, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    tokens = materialize(rows.mapInArrow(lambda b: _tokenized(b, tokenizer_path), TOKENS), "tokens")
    settle(spark)
    counted = tokens.mapInArrow(lambda b: _count(b, start), "pair long, background long, target long")
    pairs = materialize(counted.groupBy("pair").agg(F.sum("background").alias("background"), F.sum("target").alias("target")), "pairs")
    settle(spark)

    def singles_of(side: F.Column) -> dict[int, tuple[int, int]]:
        return {r["i"]: (r["t"], r["b"]) for r in pairs.groupBy(side.alias("i")).agg(F.sum("target").alias("t"), F.sum("background").alias("b")).collect()}  # at most the vocabulary

    singles = Singles(start, singles_of(F.shiftright("pair", 16)), singles_of(F.col("pair").bitwiseAND(0xFFFF)))
    if pairs.count() <= held_pairs:
        table = pairs.toArrow()
        keys = table.column("pair").to_numpy()
        order = np.argsort(keys)
        keys, counts = keys[order], np.stack([table.column(c).to_numpy()[order] for c in ("target", "background")])
        held = spark.sparkContext.broadcast((keys, counts))
        return tokens.mapInArrow(lambda b: _score_held(b, start, *held.value, singles), SCORES)
    own = tokens.mapInArrow(lambda b: _pair_rows(b, start), "doc_id long, pair long, times long")
    lost = own.join(pairs, "pair").select("doc_id", "pair", "times", "background", "target").mapInArrow(lambda b: _pair_losses(b, singles), "doc_id long, times long, t double, b double")
    sums = lost.groupBy("doc_id").agg(F.sum("times").alias("n"), F.sum("t").alias("t"), F.sum("b").alias("b"))
    t, b = F.coalesce(F.col("t") / F.col("n"), F.lit(0.0)), F.coalesce(F.col("b") / F.col("n"), F.lit(0.0))
    return tokens.select("doc_id").join(sums, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_tokens"), t.alias("loss_target"), b.alias("loss_background"), (t - b).alias("score"))
