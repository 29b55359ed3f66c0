"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import mix, small_batches, text_chunks, window_hashes

SHINGLE = 5
CONTAINED = 0.8  # least share of a template's shingles in a match
BANDS = 20  # of one row each: windows of Jaccard similarity J with a template collide with probability 1 - (1 - J) ** BANDS, at J = 0.4 0.99996
BASE = 0xC2B2AE3D27D4EB4F
STRIP = b".,;:!?\"'()[]{}<>*#"

# Public license notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    ),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)


class PlainHashes(dict):
    """64-bit hash of a word in lower case without marks around it, remembered up to a bound."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.lower().strip(STRIP))
        return value


HASHES = PlainHashes()
SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingles(text: bytes) -> np.ndarray:
    words = text.split()
    return window_hashes(np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words)), SHINGLE, BASE)


def signature(own: np.ndarray) -> np.ndarray:
    """BANDS MinHash values of a window's shingles."""
    return mix(own[None, :] ^ SEEDS[:, None]).min(1)


class Templates:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.names = [n for n, _ in templates]
        self.sets = [np.unique(shingles(t.encode())) for _, t in templates]
        self.sizes = [len(shingles(t.encode())) for _, t in templates]
        assert all(self.sizes), "a template has five words at least"
        self.bands = np.stack([signature(s) for s in self.sets])
        every = np.unique(np.concatenate(self.sets))
        self.every = every
        self.bitmap = np.zeros(1 << 16, bool)
        self.bitmap[(every >> np.uint64(48)).astype(np.int64)] = True

    def places(self, own: np.ndarray) -> np.ndarray:
        """Where a shingle of some template is: windows without any collide with none."""
        maybe = np.flatnonzero(self.bitmap[(own >> np.uint64(48)).astype(np.int64)])
        return maybe[np.isin(own[maybe], self.every)] if len(maybe) else maybe

    def matches(self, own: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(template, containment, first word, end word) of every match in a text's shingles; of overlapping ones of a template the best."""
        places = self.places(own)
        if not len(places):
            return []
        out: list[tuple[int, float, int, int]] = []
        for size in sorted(set(self.sizes)):
            stride = max(1, size // 4)
            grid = np.unique(np.concatenate([places // stride * stride - k * stride for k in range(size // stride + 1)]))
            group = [i for i, s in enumerate(self.sizes) if s == size]
            last = max(0, len(own) - size)
            for start in sorted({min(max(int(g), 0), last) for g in grid}):
                bands = signature(own[start : start + size])
                for i in group:
                    if not (bands == self.bands[i]).any():
                        continue
                    lo, hi = max(0, start - size), min(len(own), start + 2 * size)
                    near = own[lo:hi]
                    here = np.flatnonzero(np.isin(near, self.sets[i]))
                    # the template's shingles lie close together: the densest stretch of one and a half times its length
                    best = (0, 0, 0)
                    for a in here.tolist():
                        inside = here[(here >= a) & (here < a + size + size // 2 + 1)]
                        n = len(np.unique(near[inside]))
                        if n > best[0]:
                            best = (n, a, int(inside[-1]))
                    share = best[0] / len(self.sets[i])
                    if share >= CONTAINED:
                        out.append((i, share, lo + best[1], lo + best[2] + SHINGLE))
        kept: list[tuple[int, float, int, int]] = []
        for m in sorted(set(out), key=lambda m: (m[0], -m[1], m[2])):
            if not any(m[0] == k[0] and m[2] < k[3] and k[2] < m[3] for k in kept):
                kept.append(m)
        return kept


MATCHES = "doc_id long, license string, template int, containment double, word_start long, word_end long"


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row for each template found at a place of a document: doc_id, license, template (number), containment, word_start, word_end.

    Words are split at ASCII white space, lower-cased, without marks around them. At least CONTAINED of a template's five-word
    shingles are there. A scan of each text by itself: nothing is shuffled, repeated rows come again, null or short texts
    have no match, extra columns are not read.
    """
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for ids, texts in text_chunks(batches):
            found = [(i, known.names[t], t, share, a, b) for i, text in zip(ids, texts) for t, share, a, b in known.matches(shingles(text))]
            if found:
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=[c.split()[0] for c in MATCHES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(rows, MATCHES)
