"""Near-duplicate classes of documents by fast similarity sketches, banding and exact verification.

A sketch has COORDINATES bins. In each round every feature is hashed to a bin and a value; in the last half of the rounds, round
i puts all features into one bin. A bin keeps the least (round, value), and rounds end when a set has filled every bin. So
each coordinate is filled, two sets agree in it with a probability of exactly their Jaccard similarity, and the share of
agreeing coordinates concentrates about it as if features were drawn without replacement. A set of many features is done
after a round or two, where as many independent minima would hash it COORDINATES times.

Bands of ROWS coordinates are the signatures. Links at 0.8 share none with a probability of (1 - 0.8^4)^32 = 5 * 10^-8. What shares
one is compared on whole sets, as in jaccard_join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK, mix
from .jaccard_join import jaccard_classes

SHINGLE = 4
COORDINATES = 128
ROWS = 4  # coordinates of a band
VALUE_BITS = 48  # below them the value, above them the round
SEED = 0xA0761D6478BD642F


def sketches(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """The sketch of each set of hashed features, a row each; empty sets keep unfilled (greatest) values."""
    out = np.full((len(sets), coordinates), MASK, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    left = np.flatnonzero(sizes)
    if not len(left):
        return out
    features, owner = np.concatenate([sets[i] for i in left]), np.repeat(left, sizes[left])
    flat = out.reshape(-1)
    for i in range(2 * coordinates):
        seed = (SEED * (2 * i + 1)) & (2**64 - 1)
        h = mix(features ^ np.uint64(seed))
        value = np.uint64(i << VALUE_BITS) | (h >> np.uint64(64 - VALUE_BITS))
        # the low 16 bits take no part in the value
        bin_ = ((h & np.uint64(0xFFFF)) % np.uint64(coordinates)).astype(np.int64) if i < coordinates else i - coordinates
        np.minimum.at(flat, owner * coordinates + bin_, value)
        open_ = (out == MASK).any(1)
        if not open_[left].any():
            break
        keep = open_[owner]
        features, owner = features[keep], owner[keep]
        left = left[open_[left]]
    return out


def band_signatures(sets: list[np.ndarray], coordinates: int = COORDINATES, rows: int = ROWS) -> list[np.ndarray]:
    """A hash of each band of each set's sketch; none of an empty set."""
    bands = sketches(sets, coordinates).reshape(len(sets), coordinates // rows, rows)
    total = np.zeros(bands.shape[:2], np.uint64) + np.arange(bands.shape[1], dtype=np.uint64)
    for j in range(rows):
        total = mix(total + bands[:, :, j])
    return [t if len(s) else t[:0] for s, t in zip(sets, total)]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that links reach, itself included), kept.

    ASCII letters are lower-cased, words are [^\\x20\\x09-\\x0D]+, a document's set is its distinct shingles of 4 words (fewer words: the
    whole sequence). Documents link at a Jaccard similarity of 0.8 on their whole sets. Without words or with null text a
    document has the empty set and links with nothing. Of each component the document whose id names it is kept; a
    repeated row comes twice, a null id is kept if no document of known id has its text. Extra columns are not read; an
    empty table gives no rows.
    """
    classes = jaccard_classes(docs, SHINGLE, band_signatures)
    return classes.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
