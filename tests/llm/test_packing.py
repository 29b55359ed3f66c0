from __future__ import annotations

import zlib

import numpy as np
import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing
from tessera.llm.tokens import WordTokens

pytest.importorskip("tokenizers")
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def test_ids_are_the_tokenizers(rows):
    t = WordTokens(TOKENIZER)
    texts = [(r[1] or "") for r in rows] + ["İstanbul Σίσυφος a\x85b c\xa0d 12x 'tis we'll!!"]
    ids, offsets = t.encode([x.encode() for x in texts])
    for x, a, b in zip(texts, offsets, offsets[1:]):
        assert t.tokenizer.encode(x, add_special_tokens=False).ids == ids[a:b].tolist()


def test_forgetting_changes_nothing(rows):
    t = WordTokens(TOKENIZER)
    t.words.limit, t.pieces.limit, t.words.YOUNG = 40, 40, 10
    for r in rows[:14]:
        ids, _ = t.encode([(r[1] or "").encode()])
        assert ids.tolist() == t.tokenizer.encode(r[1] or "", add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [16, 2048])
def test_round_trip(docs, rows, capacity):
    t = WordTokens(TOKENIZER)
    got = packing.pack(docs, TOKENIZER, capacity).toPandas()
    for i, text, *_ in rows:
        ids = np.append(t.encode([(text or "").encode()])[0], 0).astype("<u4")
        own = got[got["doc_id"] == i].sort_values("piece")
        assert own["piece"].tolist() == list(range(-(-len(ids) // capacity)))
        for p in own.itertuples():
            part = ids[p.start : p.start + p.length]
            assert len(part) == p.length and zlib.crc32(part.tobytes()) == p.ids_crc32
            assert p.start == p.piece * capacity
        assert own["length"].sum() == len(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= capacity


def test_repeated_rows_and_no_rows(docs, no_docs):
    assert packing.pack(docs.unionAll(docs), TOKENIZER).count() == 2 * packing.pack(docs, TOKENIZER).count()
    assert packing.pack(no_docs, TOKENIZER).count() == 0


def fewest(items: list[int], capacity: int) -> int:
    """The least number of bins, by trying all placements."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i: int, room: tuple[int, ...]) -> None:
        if len(room) >= best[0]:
            return
        if i == len(items):
            best[0] = len(room)
            return
        for k in range(len(room)):
            if room[k] >= items[i] and room[k] not in room[:k]:
                go(i + 1, (*room[:k], room[k] - items[i], *room[k + 1 :]))
        go(i + 1, (*room, capacity - items[i]))

    go(0, ())
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_fixed_sets_never_cost_a_bin(items):
    counts = {s: items.count(s) for s in items}
    fixed, left = packing.reduce_dominated(counts, 20)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + (fewest(rest, 20) if rest else 0) == fewest(items, 20)
    placed = sorted([s for sizes, n in fixed for s in sizes for _ in range(n)] + rest)
    assert placed == sorted(items)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1, max_size=12))
def test_best_fit_on_counts_is_best_fit_decreasing(counts):
    room: list[int] = []
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fits = [k for k in range(len(room)) if room[k] >= s]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= s
        else:
            room.append(50 - s)
    got = packing.best_fit(dict(counts), 50)
    assert sum(n for _, n in got) == len(room)
    slots = packing.packed_slots(dict(counts), 50)
    assert sum(b - a for _, a, b, *_ in slots.tolist()) == sum(counts.values())
