"""Benchmark decontamination by latent semantic retrieval and longest common subsequences.

Texts are rows of hashed word numbers. Passages are windows of two blocks of words at every block. Their TF-IDF matrix, all
passages of all documents, gets a randomised singular value decomposition: one pass gathers (A'A)Omega in the tasks, the rest is
a small matrix. Passages whose whitened latent vectors are near an item's are candidates; of these the longest common
subsequence with the item decides, with the item's answer where only a paraphrase is common.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, grouped_batches, materialize, settle, small_batches, sorted_groups, text_bytes, text_chunks, word_hashes

BLOCK = 16  # words; a passage has two blocks
FEATURES = 1 << 14
RANK = 64
NEAR = 0.4  # least cosine of a candidate
SAME = 0.75  # share of an item's words in a common subsequence that is a leak by itself
ALIKE = 0.5  # share that is one if the item's answer is there too
ITEM_BYTES, ITEMS = 1 << 18, 1024  # benchmark text and items that are held at once; a larger benchmark is taken in slices
PREFIX = 20  # bits of a word that tell at once that no item has it
PIECE = 1 << 16  # words whose vectors are held at once
SUMS = 64  # features in one row of partial sums
TASK_BYTES = 32 << 20  # words' numbers that a task of the decomposition reads, about
NONE = FEATURES  # feature of the words that fill up a text's last block

WORDS = "doc_id long, words binary, df array<long>"


def numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit numbers of all words, ASCII letters lower-cased, and the offsets of the texts."""
    return word_hashes([t.lower() for t in texts])


def features(words: np.ndarray) -> np.ndarray:
    """The hashed feature of each word in the TF-IDF matrix."""
    return ((words >> np.uint64(48)) & np.uint64(FEATURES - 1)).astype(np.int64)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's word numbers; last, a row with the task's numbers of passages that have each feature."""
    df = np.zeros(FEATURES + 1, np.int64)  # at the end the number of passages
    for ids, texts in text_chunks(batches):
        words, offsets = numbers(texts)
        own = np.sort(_padded(features(words), offsets, NONE)[0].astype(np.uint16), axis=1)
        if len(own):
            new = np.ones(own.shape, bool)
            new[:, 1:] = own[:, 1:] != own[:, :-1]
            df[:-1] += np.bincount(own[new], minlength=FEATURES + 1)[:FEATURES]
            df[-1] += len(own)
        rows = [words[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary()), pa.array([None] * len(ids), pa.list_(pa.int64()))], names=["doc_id", "words", "df"])
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([df.tolist()], pa.list_(pa.int64()))], names=["doc_id", "words", "df"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(doc_ids, words, offsets) of about PIECE words; a longer document comes alone."""
    for batch in batches:
        ids, rows = batch.column("doc_id").to_pylist(), batch.column("words").to_pylist()
        at = 0
        while at < len(ids):
            end, size = at, 0
            while end < len(ids) and (end == at or size + len(rows[end]) // 8 <= PIECE):
                size += len(rows[end]) // 8
                end += 1
            yield ids[at:end], np.frombuffer(b"".join(rows[at:end]), np.uint64), np.concatenate([[0], np.cumsum([len(r) // 8 for r in rows[at:end]])])
            at = end


def _padded(words: np.ndarray, offsets: np.ndarray, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """(words in rows of a block each, number of each row's text); texts' last rows are filled up."""
    n = np.diff(offsets)
    per = -(-n // BLOCK)
    text = np.repeat(np.arange(len(n)), per)
    out = np.full(len(text) * BLOCK, fill, np.int64)
    shift = np.repeat((np.cumsum(per) - per) * BLOCK - offsets[:-1], n)
    out[np.arange(len(words)) + shift] = words
    return out.reshape(-1, BLOCK), text


def _summed(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of values of each row's words, a piece at a time."""
    step = PIECE // BLOCK // 8
    parts = [values[rows[a : a + step]].sum(1) for a in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros((0, *values.shape[1:]), np.float32)


def _passages(blocks: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Each block with the next of its text."""
    out = blocks.copy()
    same = text[1:] == text[:-1]
    out[:-1][same] += blocks[1:][same]
    return out


def _range_rows(batches: Iterator[pa.RecordBatch], idf: np.ndarray, omega: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The task's share of (A'A)Omega in rows of SUMS features; A: passages of unit TF-IDF length."""
    rank = omega.shape[1]
    total = np.zeros((rank, FEATURES + 1))
    weighted = np.vstack([omega * idf[:, None], np.zeros((1, rank))]).astype(np.float32)
    squares = np.append(idf * idf, 0).astype(np.float32)
    for _, words, offsets in _pieces(batches):
        if not len(words):
            continue
        f, text = _padded(features(words), offsets, NONE)
        y = _passages(_summed(weighted, f), text) / np.maximum(_passages(_summed(squares, f), text), 1e-12)[:, None]
        back = y.copy()  # a block is in its own passage and in the one before
        same = text[1:] == text[:-1]
        back[1:][same] += y[:-1][same]
        flat = f.ravel()
        each = np.repeat(np.ascontiguousarray(back.T), BLOCK, axis=1)
        for k in range(rank):
            total[k] += np.bincount(flat, each[k], FEATURES + 1)
    total = total[:, :-1].T.copy()
    total *= idf[:, None]
    rows = total.reshape(FEATURES // SUMS, -1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int64)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["part", "sums"])


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in grouped_batches(batches, ["part"]):
        total = np.sum([np.frombuffer(x, np.float64) for x in group.column("sums").to_pylist()], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([group.column("part")[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])


def latent_space(numbered: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """FEATURES x rank: maps TF-IDF rows to whitened coordinates on the leading right singular vectors (a one-pass randomised decomposition)."""
    omega = np.random.default_rng(seed).standard_normal((FEATURES, rank))
    parts = numbered.where("doc_id is not null").mapInArrow(lambda b: _range_rows(b, idf, omega), "part long, sums binary")
    added = sorted_groups(parts, ["part"]).mapInArrow(_add_rows, "part long, sums binary").toArrow()
    y = np.zeros((FEATURES, rank))
    for part, sums in zip(added.column("part").to_pylist(), added.column("sums").to_pylist()):
        y[part * SUMS : (part + 1) * SUMS] = np.frombuffer(sums, np.float64).reshape(SUMS, rank)
    # A'A is near Y (Omega'Y)^-1 Y': its eigenvectors are the left singular vectors of Y (Omega'Y)^-1/2
    core = (omega.T @ y + y.T @ omega) / 2
    values, vectors = np.linalg.eigh(core)
    keep = values > 1e-9 * max(values.max(), 1e-300)
    if not keep.any():
        return np.zeros((FEATURES, rank))
    u, s, _ = np.linalg.svd(y @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    # of a matrix with hardly more rows than the rank, the last directions are noise
    return u / np.maximum(s, 0.05 * s[0])


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, with a's places as bits of one number."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = at.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Items:
    """A slice of the benchmark: word numbers, answers (the last sentence), and latent vectors of each item's passages."""

    def __init__(self, ids: list[int], texts: list[bytes], latent: np.ndarray):
        self.ids, self.words, self.answers = [], [], []
        vectors, self.of = [], []
        for i, t in zip(ids, texts):
            words = numbers([t])[0]
            if not len(words):
                continue
            sentences = [s for s in re.split(rb"(?<=[.!?])\s+", t.strip()) if s.strip()]
            self.ids.append(i)
            self.words.append(words.tolist())
            self.answers.append(numbers([sentences[-1]])[0])
            for a in range(0, max(1, len(words) - BLOCK), BLOCK) if len(words) > 3 * BLOCK else [0]:
                part = words[a : a + 2 * BLOCK] if len(words) > 3 * BLOCK else words
                vectors.append(latent[features(part)].sum(0))
                self.of.append(len(self.ids) - 1)
        self.of = np.array(self.of, np.int64)
        v = np.array(vectors).reshape(-1, latent.shape[1])
        self.vectors = (v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]).astype(np.float32)


LEAKS = "doc_id long, item_id long, common int, item_words int, share double, answer boolean, word_start long, cosine double"


class Bounds:
    """What stretches of blocks can have of each item at most, and where texts have answers whole."""

    def __init__(self, items: Items):
        self.length = np.array([len(w) for w in items.words])
        self.answers = items.answers
        self.vocabulary = np.unique(np.concatenate([np.array(w, np.uint64) for w in items.words]))
        self.maybe = np.zeros(1 << PREFIX, bool)  # whether a word of the items begins with these bits
        self.maybe[(self.vocabulary >> np.uint64(64 - PREFIX)).astype(np.int64)] = True
        self.has = np.zeros((len(self.vocabulary) + 1, len(items.words)), np.uint8)
        self.each = -(-self.length // 64)  # places of an item that one of 64 bits stands for
        bits: dict[int, int] = {}
        for i, (w, each) in enumerate(zip(items.words, self.each.tolist())):
            own = self.rows(np.array(w, np.uint64))
            self.has[own, i] = 1
            for j, r in enumerate(own.tolist()):
                key = i * len(self.has) + r
                bits[key] = bits.get(key, 0) | 1 << j // each
        self.keys = np.array(sorted(bits))
        self.bits = np.array([bits[k] for k in self.keys.tolist()], np.uint64)

    def rows(self, words: np.ndarray) -> np.ndarray:
        """Each word's number among the items' words, from 1; 0 of other words."""
        out = np.zeros(len(words), np.int64)
        some = np.flatnonzero(self.maybe[(words >> np.uint64(64 - PREFIX)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, words[some]), len(self.vocabulary) - 1)
        out[some] = np.where(self.vocabulary[at] == words[some], at + 1, 0)
        return out

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """Running sums over blocks of the words that each item has; a stretch's is at least any common subsequence."""
        out = np.zeros((len(rows) + 1, len(self.length)), np.int32)
        for a in range(0, len(rows), PIECE // BLOCK // 8):
            own = self.has[rows[a : a + PIECE // BLOCK // 8]].sum(1, dtype=np.uint8)
            out[a + 1 : a + 1 + len(own)] = own
        return np.cumsum(out, axis=0, out=out)

    def covered(self, rows: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Upper bounds of the places of each item whose word is in the blocks from begin to end."""
        seen = np.zeros(len(item), np.uint64)
        for d in range(int((end - begin).max(initial=0))):
            own = rows[np.minimum(begin + d, end - 1)]
            at, k = np.nonzero(self.has[own, item[:, None]])
            np.bitwise_or.at(seen, at, self.bits[np.searchsorted(self.keys, item[at] * len(self.has) + own[at, k])])
        return np.bitwise_count(seen) * self.each[item]

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Where a text's words, by their rows, have answers whole: item << 40 | place of the first word, ascending."""
        some = np.flatnonzero(rows)
        order = some[np.argsort(rows[some], kind="stable")]
        answers = [self.rows(a) for a in self.answers]
        first = np.array([a[0] for a in answers], np.int64)
        out = [np.zeros(0, np.int64)]
        for i, (a, b) in enumerate(zip(*(np.searchsorted(rows[order], first, side).tolist() for side in ("left", "right")))):
            answer, at = answers[i], order[a:b]
            at = at[at <= len(rows) - len(answer)]
            for k in range(1, len(answer)):
                if not len(at):
                    break
                at = at[rows[at + k] == answer[k]]
            out.append((i << 40) + at)
        return np.concatenate(out)


def _leaks(batches: Iterator[pa.RecordBatch], items: Items, latent: np.ndarray) -> Iterator[pa.RecordBatch]:
    latent = np.vstack([latent, np.zeros((1, latent.shape[1]))]).astype(np.float32)
    bounds = Bounds(items)
    for ids, words, offsets in _pieces(batches):
        if not len(words):
            continue
        f, text = _padded(features(words), offsets, NONE)
        p = _passages(_summed(latent, f), text)
        p /= np.maximum(np.linalg.norm(p, axis=1), 1e-12)[:, None]
        first, last = np.searchsorted(text, text), np.searchsorted(text, text, "right")  # rows of each row's text
        known = bounds.rows(words)
        own = _padded(known, offsets, 0)[0]
        counts, places = bounds.counts(own), bounds.places(known)
        rows: dict[tuple[int, int], tuple] = {}
        for a in range(0, len(p), 4096):
            cosine = p[a : a + 4096] @ items.vectors.T
            at, q = np.nonzero(cosine >= NEAR)
            new = np.ones(len(at), bool)  # an item's passages follow each other
            new[1:] = (at[1:] != at[:-1]) | (items.of[q[1:]] != items.of[q[:-1]])
            at, item, c = at[new] + a, items.of[q[new]], cosine[at[new], q[new]]
            n, doc = bounds.length[item], text[at]
            begin = offsets[doc] + (at - first[at]) * BLOCK
            lo, hi = np.maximum(offsets[doc], begin - n), np.minimum(offsets[doc + 1], begin + 2 * BLOCK + n)
            found = np.append(places, np.iinfo(np.int64).max)[np.searchsorted(places, (item << 40) + lo)]
            there = found <= (item << 40) + hi - np.array([len(x) for x in items.answers])[item]
            need = np.where(there, ALIKE, SAME) * n
            # only what can't have as many words in common is left out before the subsequence
            reach = -(-n // BLOCK)
            low, high = np.maximum(first[at], at - reach), np.minimum(last[at], at + 2 + reach)
            some = np.flatnonzero(counts[high, item] - counts[low, item] >= need)
            for s in range(0, len(some), 4096):
                part = some[s : s + 4096]
                part = part[bounds.covered(own, item[part], low[part], high[part]) >= need[part]]
                for d, i, x, y, least, whole, near in zip(*(v[part].tolist() for v in (doc, item, lo, hi, need, there, c))):
                    wanted, was = items.words[i], rows.get((d, i))
                    if was and was[0] == len(wanted):
                        continue
                    common = common_subsequence(wanted, words[x:y].tolist())
                    if common >= least and (not was or common > was[0]):
                        rows[d, i] = (common, len(wanted), common / len(wanted), whole, x - int(offsets[d]), near)
        if rows:
            cols = list(zip(*((ids[d], items.ids[i], *r) for (d, i), r in rows.items())))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in LEAKS.split(", ")])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that it has: doc_id, item_id, common, item_words, share, answer, word_start, cosine.

    An item is in a document if they have at least SAME of the item's words in one order close together, or ALIKE of them and the
    item's last sentence whole. ASCII case is ignored. Null or empty texts have no words and are in nothing; items without words
    are nowhere. Words are compared by 64-bit hashes. Rows that repeat a document may give their leaks as often. Texts of any length are read
    whole. Extra columns are not read. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    numbered = materialize(docs.mapInArrow(_numbered, WORDS), "numbered")
    df = np.zeros(FEATURES + 1, np.int64)
    counts = numbered.where("doc_id is null").select(F.posexplode("df").alias("f", "n")).groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    df[counts.column("f").to_numpy()] = counts.column("n").to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1
    # a task's sums take FEATURES x RANK numbers whatever it reads: few tasks, so that they stay a part of what is read
    tasks = max(1, -(-int(df[-1]) * BLOCK * 8 // TASK_BYTES))
    latent = latent_space(numbered.coalesce(tasks), idf) * idf[:, None]
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    size, number = bench.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    slices = max(1, -(-(size or 0) // ITEM_BYTES), -(-number // ITEMS))
    out = None
    for i in range(slices):
        rows = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == i).toArrow()
        items = Items(rows.column("item_id").to_pylist(), text_bytes(rows.column("text")), latent)
        own = numbered.where("doc_id is not null").mapInArrow(lambda b, items=items: _leaks(b, items, latent) if items.ids else iter(()), LEAKS)
        out = own if out is None else out.unionAll(own)
    return out
