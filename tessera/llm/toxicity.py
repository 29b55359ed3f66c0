"""Toxicity by compression distance: which of two zstandard dictionaries, of toxic or of ordinary text, makes a window shorter.

Texts are read in windows of WORDS words. Both dictionaries begin with one base, trained on ordinary text, so that ordinary
stretches cost the same with either; after it each has its own part, trained on windows of its own class in ROUNDS: each
round trains on those windows that the dictionary so far makes least short for their length. A window's distance is its length
with the ordinary dictionary less that with the toxic one; a window that the ordinary dictionary makes as short as most ordinary
ones of its length is ordinary, has distance 0 and needs no second compression. A text is shown by how many of its windows pass
each threshold; a logistic calibration on labelled documents that the dictionaries have not seen turns that into a score.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches, text_chunks

WORDS = 8  # words of a window
SAMPLE = (3000, 6000)  # labelled documents to learn from at most: toxic, ordinary; half for the dictionaries, half to calibrate
WINDOWS = (100_000, 300_000)  # windows of these, picked by hash, that the dictionaries are trained on at most
BASE, OWN, ROUNDS, WORST = 400_000, 1536, 6, 0.04  # bytes of the base and of a round's part; rounds; share of the windows of a round
LEVEL = 16
EXPLAINED = 0.65  # share of ordinary windows that count as ordinary by the ordinary dictionary alone
TOP = 9  # distances are counted from 1 to TOP


def windows(text: bytes) -> list[bytes]:
    """Lower-cased words of the whole text, WORDS at a time; the last window may be shorter."""
    words = (text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode("utf-8")).split()
    return [b" " + b" ".join(words[i : i + WORDS]) + b" " for i in range(0, len(words), WORDS)]


def compressor(dictionary: bytes):
    import zstandard as z

    how = z.ZstdCompressionParameters.from_level(LEVEL, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0, min_match=3, search_log=4, hash_log=17, chain_log=20)
    held = z.ZstdCompressionDict(dictionary)
    held.precompute_compress(compression_params=how)
    return z.ZstdCompressor(dict_data=held, compression_params=how).compress


Gate = tuple[float, float]  # a window of n bytes that the ordinary dictionary makes shorter than gate[0] * n + gate[1] is ordinary


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    gate: Gate
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float


_HELD: dict[int, tuple] = {}


def distances(texts: list[bytes], toxic: bytes, ordinary: bytes, gate: Gate) -> list[np.ndarray]:
    """For each text, each window's length with the ordinary dictionary less that with the toxic one, from 0 to TOP.

    A window that occurs several times in these texts is compressed once. All go through one dictionary before any goes through
    the other: turn by turn, each would push the other's tables out of the processor's caches.
    """
    key = zlib.crc32(toxic) << 32 | zlib.crc32(ordinary)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = compressor(toxic), compressor(ordinary)
    by_toxic, by_ordinary = _HELD[key]
    place: dict[bytes, int] = {}
    at = [np.fromiter([place.setdefault(w, len(place)) for w in windows(t)], np.int64) for t in texts]
    own = list(place)
    length = np.fromiter(map(len, map(by_ordinary, own)), np.int64, len(own))
    rest = np.flatnonzero(length >= gate[0] * np.fromiter(map(len, own), np.int64, len(own)) + gate[1])
    apart = np.zeros(len(own), np.int64)
    apart[rest] = np.clip(length[rest] - np.fromiter((len(by_toxic(own[i])) for i in rest.tolist()), np.int64, len(rest)), 0, TOP)
    return [apart[i] for i in at]


def features(texts: list[bytes], toxic: bytes, ordinary: bytes, gate: Gate) -> np.ndarray:
    """A row for each text: shares and numbers of windows at each distance or beyond, and the length; the shares saturate."""
    out = np.zeros((len(texts), 3 * TOP + 1))
    for row, own in zip(out, distances(texts, toxic, ordinary, gate)):
        n = len(own)
        beyond = np.bincount(own, minlength=TOP + 1)[::-1].cumsum()[::-1][1:].astype(float)
        share = beyond / max(n, 1)
        row[:] = [*np.sqrt(share), *np.minimum(share * 10, 1.0), *np.log1p(beyond), math.log1p(n)]
    return out


def _trained(samples: list[bytes], size: int):
    """A dictionary that zstandard trains on the samples; None of too little text."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, d=6, k=9 if size < 4096 else 32, steps=0)
    except (z.ZstdError, ValueError):
        return None


def _content(samples: list[bytes], size: int) -> bytes:
    """What such a dictionary holds, without its tables."""
    held = _trained(samples, size + 300)
    return held.as_bytes()[-size:] if held else b"".join(samples)[-size:]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes, Gate]:
    """(toxic, ordinary, gate): trained on windows of either class; the gate on ordinary ones that the base has not seen."""
    cut = len(ordinary) * 3 // 4
    held = _trained(ordinary[:cut], BASE)
    base = held.as_bytes() if held else (b"".join(ordinary[:cut])[-BASE:] or b" " * 8)

    def line(size: np.ndarray, cost: np.ndarray) -> np.ndarray:
        return np.polyfit(size, cost, 1) if len(np.unique(size)) > 1 else np.zeros(2)

    def with_own(samples: list[bytes]) -> bytes:
        out = base
        size = np.array([len(w) for w in samples], float)
        for _ in range(ROUNDS if samples else 0):
            compress = compressor(out)
            cost = np.array([len(compress(w)) for w in samples], float)
            cost -= np.polyval(line(size, cost), size)
            worst = np.argsort(-cost, kind="stable")[: max(64, int(len(samples) * WORST))]
            out += _content([samples[i] for i in worst.tolist()], OWN)
        return out

    ends = with_own(toxic), with_own(ordinary[cut:])
    some = ordinary[cut:][:20_000]
    compress = compressor(ends[1])
    size, cost = np.array([len(w) for w in some], float), np.array([len(compress(w)) for w in some], float)
    slope, least = line(size, cost)
    return *ends, (float(slope), float(least + np.quantile(cost - slope * size - least, EXPLAINED)) if some else 0.0)


def calibrated(x: np.ndarray, y: np.ndarray, dicts: tuple[bytes, bytes, Gate], share: float) -> ToxicityModel:
    """Newton's method on the penalised likelihood; `share`: of all labelled documents, those of label 1 (the sample has more)."""
    centre, scale = x.mean(0), x.std(0) + 1e-6
    one = np.hstack([(x - centre) / scale, np.ones((len(x), 1))])
    w = np.zeros(one.shape[1])
    ridge = np.diag([1.0] * x.shape[1] + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
        step = np.linalg.solve((one * (p * (1 - p))[:, None]).T @ one + ridge, one.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return ToxicityModel(*dicts, tuple(centre), tuple(scale), tuple(w[:-1]), float(w[-1] + math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))))


def score(texts: list[bytes], model: ToxicityModel | None) -> np.ndarray:
    if model is None or not texts:
        return np.zeros(len(texts))
    x = features(texts, model.toxic, model.ordinary, model.gate)
    z = ((x - np.array(model.centre)) / np.array(model.scale)) @ np.array(model.weights) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [windows(t or b"") for t in batch.column("text").to_pylist()]
        y = np.repeat(batch.column("y").to_numpy(), [len(w) for w in own])
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array([w for ws in own for w in ws], pa.binary())], names=["y", "w"])


def train_on(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> ToxicityModel | None:
    """Learns from a bounded sample of labelled documents (SAMPLE), picked by a hash of the id, none of the held-out fifth.

    Documents of every length take part, on their whole texts; to the driver come at most WINDOWS windows and the sample's
    features. Labels that are null or have no document count for nothing; of several for one document the largest counts;
    equal texts count once. None unless both labels occur in both halves of the sample.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select("doc_id", label).where(~is_held_out()).where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).alias("y")).select("doc_id", (F.col("y") != 0).cast("int").alias("y"))
    known = materialize(docs.select("doc_id").distinct().join(known, "doc_id"), "known")
    number = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows at most
    if len(number) < 2:
        return None
    picks = None
    for y, n in ((1, SAMPLE[0]), (0, SAMPLE[1])):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picks = some if picks is None else picks.unionAll(some)
    rows = docs.select("doc_id", "text").join(F.broadcast(picks), "doc_id")  # at most sum(SAMPLE) ids
    rows = rows.select("y", F.col("text").cast("binary").alias("text")).dropDuplicates(["y", "text"])
    rows = materialize(rows.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2))), "labelled")
    seen = rows.where("half = 0").select("y", "text").mapInArrow(_window_rows, "y int, w binary")
    samples = [seen.where(F.col("y") == y).orderBy(F.xxhash64("w"), "w").limit(n).select("w").toArrow().column("w").to_pylist() for y, n in ((1, WINDOWS[0]), (0, WINDOWS[1]))]
    if not all(samples):
        return None
    for own in samples:  # the trainer picks stretch by stretch: sorted windows would leave it little choice
        random.Random(7).shuffle(own)
    dicts = dictionaries(*samples)

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [row for _, texts in text_chunks(iter([batch.rename_columns(["doc_id", "text"])])) for row in features(texts, *dicts)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    shares = rows.where("half = 1").select("y", "text").mapInArrow(shown, "y int, x array<double>").orderBy("y", "x").toArrow()
    discard(rows)
    discard(known)
    y = shares.column("y").to_numpy().astype(float)
    if len(np.unique(y)) < 2:
        return None
    return calibrated(np.array(shares.column("x").to_pylist()), y, dicts, number[1] / (number[0] + number[1]))


def score_toxicity(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """Every row with toxicity (0 to 1) and toxic (1 if toxicity >= 0.5), on its whole text.

    Null text counts as empty; no model: 0. Repeated rows are scored again; an empty table gives no rows. Columns of the input
    called toxicity or toxic are replaced, others stay.
    """
    small_batches(docs.sparkSession)
    own = docs.drop("toxicity", "toxic")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score(texts, model) for _, texts in text_chunks(iter([pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text")], names=["doc_id", "text"])]))]
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names, "toxicity", "toxic"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInArrow(rows, f"{kinds}, toxicity double, toxic int")
