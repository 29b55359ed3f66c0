"""Content-defined anchors: from equal windows of units (words or bytes) of any two texts the same anchor is picked.

Each window of `window` units is shown by its k-gram with the least hash (the last of equal ones), of all or only of chosen
k-grams; windows without a chosen one are left out. Windows in a row with one anchor are a run. So only anchors, about 2 / (window - k + 2) of the units, need to be compared between texts.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .common import MASK, sliding_min, window_hashes

PLACES = 26  # bits for the place in a segment; the rest are the hash
SEGMENT = 1 << 25  # units looked at together; longer texts go in segments that overlap by a window
BASE = 0xD6E8FEB86659FD93


class Runs(NamedTuple):
    text: np.ndarray  # number of the text
    start: np.ndarray  # first window's place in its text
    count: np.ndarray  # windows
    anchor: np.ndarray  # place of the anchor's k-gram in its text
    key: np.ndarray  # hash of the k-gram
    flat: np.ndarray  # first window's place in the units of all texts


def _segment(units: np.ndarray, text: np.ndarray, offsets: np.ndarray, window: int, k: int, chosen: np.ndarray | None) -> Runs | None:
    n = len(units) - window + 1
    if n <= 0:
        return None
    grams = window_hashes(units, k, BASE)
    last = np.uint64((1 << PLACES) - 1)
    ranked = (grams & ~last) | (last - np.arange(len(grams), dtype=np.uint64))
    if chosen is not None:
        ranked[~chosen[: len(grams)]] = MASK
    least = sliding_min(ranked, window - k + 1)
    best = (last - (least & last)).astype(np.int64)
    inside = text[:n] == text[window - 1 :]
    if chosen is not None:
        inside &= least != MASK
    new = np.ones(n, bool)
    new[1:] = (best[1:] != best[:-1]) | (text[1:n] != text[: n - 1]) | ~inside[:-1]
    at = np.flatnonzero(new & inside)
    if not len(at):
        return None
    stop = np.append(np.flatnonzero(new | ~inside), n)
    end = stop[np.searchsorted(stop, at, "right")]
    own = text[at]
    return Runs(own, at - offsets[own], end - at, best[at] - offsets[own], grams[best[at]], at)


def runs(units: np.ndarray, offsets: np.ndarray, window: int, k: int, chosen: np.ndarray | None = None) -> Runs:
    """The runs of all texts whose units follow each other; offsets: where each starts, and the end; chosen: which units start k-grams that may be anchors."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    found = []
    for a in range(0, max(1, len(units)), SEGMENT):
        b = a + SEGMENT + window - 1
        part = _segment(units[a:b], text[a:b], offsets - a, window, k, None if chosen is None else chosen[a:b])
        if part is not None:
            found.append(part._replace(flat=part.flat + a))
    if not found:
        return Runs(*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.int64)))
    return Runs(*(np.concatenate(x) for x in zip(*found)))


def union_spans(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint sorted spans that cover the places from each a to its b (exclusive); what touches is one."""
    if not len(a):
        return []
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    first = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
    return list(zip(a[first].tolist(), b[np.append(first[1:], len(a)) - 1].tolist()))
