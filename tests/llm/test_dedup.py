from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import components, jaccard_join, substring_dedup, suffix_dedup, winnow
from tessera.llm.common import sliding_min, window_hashes


def brute_classes(rows, k=5):
    ids = [r[0] for r in rows]
    sets = []
    for r in rows:
        w = [x.lower() for x in (r[1] or "").encode().split()]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(ids[i]), find(ids[j])))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in zip(ids, sets)}


def test_classes_equal_brute_force(docs, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(docs).collect()}
    assert got == brute_classes(rows)


def test_classes_at_the_threshold(spark):
    """Pairs of all sizes just at and below 0.8, and chains that only link one by one."""
    r, rows, n = random.Random(5), [], 0
    for size in (5, 6, 8, 9, 10, 12, 20, 45, 46, 90, 91, 200, 401):
        words = [f"w{size}x{i}" for i in range(size)]
        for cut in (0, 1, 2, size // 10, size // 9, size // 9 + 1, size // 5):
            rows.append((n, " ".join(words[: size - cut] + [f"z{n}y{i}" for i in range(r.choice((0, cut)))])))
            n += 1
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_classes_of_a_large_near_family(spark):
    r = random.Random(6)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for n in range(500):
        w = list(base)
        w[r.randrange(80)] = f"z{n}"
        rows.append((n, " ".join(w)))
    rows += [(1000 + n, " ".join(base[:30] + [f"q{n}x{i}" for i in range(50)])) for n in range(100)]
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")["component_id"]
    assert got.to_dict() == {i: c for i, (_, c) in brute_classes(rows).items()}


def test_no_documents(no_docs):
    assert jaccard_join.jaccard_classes(no_docs).count() == 0
    assert substring_dedup.dedup_substrings(no_docs).count() == 0
    assert suffix_dedup.dedup_suffixes(no_docs).count() == 0


def test_signatures_are_shared_by_all_linked_sets():
    r = np.random.default_rng(7)
    for size in [*range(1, 60), 100, 333, 1000]:
        a = r.integers(0, 2**63, size).astype(np.uint64)
        for _ in range(4):
            drop = int(r.integers(0, size // 5 + 1))
            b = np.unique(np.concatenate([a[drop:], r.integers(0, 2**63, max(0, (size - drop) // 9 - drop)).astype(np.uint64)]))
            if len(b) and jaccard_join.linked(np.unique(a), b):
                x, y = jaccard_join.signatures([np.unique(a), b])
                assert np.intersect1d(x, y).size
                assert jaccard_join.possible(np.array([len(np.unique(a)), len(b)]), [jaccard_join.bucket_counts(np.unique(a)), jaccard_join.bucket_counts(b)])[0, 1]


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 700), (700, 600), (5, 5), (None, 3), (600, 500)]
    got = {r["node"]: r["component_id"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 600: 500, 700: 500}


def brute_words(rows, window):
    first, out = {}, {}
    for i, text in sorted((r[0], r[1]) for r in rows):
        w = (text or "").encode().split()
        own, gone = set(), bytearray(len(w))
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            own.add(k)
            if k in first:
                gone[j : j + window] = b"\1" * window
        for k in own:
            first.setdefault(k, i)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("window", "phrase", "variants"), [(50, 10, 2000), (12, 4, 2000), (12, 4, 1)])
def test_substrings_equal_brute_force(docs, rows, window, phrase, variants, monkeypatch):
    monkeypatch.setattr(substring_dedup, "VARIANTS", variants)  # 1: windows of all phrases are dealt out
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup_substrings(docs, window, phrase).collect()}
    assert got == brute_words(rows, window)


def brute_bytes(rows, length):
    seen, out = set(), {}
    for i, text in sorted((r[0], r[1]) for r in rows):
        t = (text or "").encode()
        gone = bytearray(len(t))
        for j in range(len(t) - length + 1):
            if t[j : j + length] in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(t[j : j + length])
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("texts", [2000, 1])
def test_suffixes_equal_brute_force(docs, rows, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TEXTS", texts)  # 1: every anchor has several shards
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup_suffixes(docs).collect()}
    assert got == brute_bytes(rows, 100)


@pytest.mark.parametrize("texts", [2000, 1])
def test_suffixes_of_repeated_and_null_rows(spark, texts, monkeypatch):
    """A repeated row counts once and gets its document's result; rows without an id keep all and take nothing."""
    monkeypatch.setattr(suffix_dedup, "TEXTS", texts)
    r = random.Random(12)
    text = lambda n: " ".join("".join(r.choice("abcdefghi") for _ in range(5)) for _ in range(n))
    shared = text(60)
    rows = [(1, text(10) + " " + shared), (2, shared + " " + text(12)), (3, text(5) + shared[:150] + text(30) + shared), (4, text(80)), (5, shared)]
    want = brute_bytes(rows, 100)
    many = [rows[0], rows[0], rows[1], rows[2], rows[2], rows[2], rows[3], rows[3], rows[4], (None, shared), (None, shared)]
    got = suffix_dedup.dedup_suffixes(spark.createDataFrame(many, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(many)
    for x in got:
        own = (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"])
        assert own == (want[x["doc_id"]] if x["doc_id"] else (len(shared), 0, 0, hashlib.sha256(shared.encode()).hexdigest()))


def test_intervals_are_equal_prefixes():
    r = np.random.default_rng(8)
    text = np.concatenate([np.tile(r.integers(97, 100, 40), 5), r.integers(97, 99, 300), [255]]).astype(np.uint8)
    for length in (1, 2, 7, 20, 64, 100):
        order, interval = suffix_dedup.equal_intervals(text, length)
        own = {}
        for p, g in zip(order.tolist(), interval.tolist()):
            own.setdefault(bytes(text[p : p + length]), set()).add(g)
        # suffixes cut short by the end differ from all others
        full = {k: v for k, v in own.items() if len(k) == length}
        assert all(len(v) == 1 for v in full.values()) and len({next(iter(v)) for v in full.values()}) == len(full)


def test_the_automaton_alone_finds_occurrences(monkeypatch):
    """Without hits there are no runs, and of a phrase that is not compiled no window is found."""
    import pyarrow as pa

    r = random.Random(3)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shared = text(200)
    texts = [text(60) + " " + shared, shared + " " + text(80), text(300)]
    keys = []
    for t in texts[:2]:
        words, offsets = substring_dedup.word_hashes([t.encode()])
        keys.append(winnow.runs(words, offsets, 50, 10).key.view(np.int64).tolist())
    both = sorted(set(keys[0]) & set(keys[1]))

    def located(own):
        batch = pa.RecordBatch.from_pydict({"shard": [0] * 3, "part": [0] * 3, "streamed": [True] * 3, "doc_id": [1, 2, 3], "text": texts, "keys": [own, None, None]})
        return [x for b in substring_dedup._locate(iter([batch]), 50, 10) for x in b.to_pylist()]

    rows = located(both)
    assert {x["doc_id"] for x in rows} == {1, 2} and {x["key"] for x in rows} == set(both)
    less = located(both[1:])
    assert {x["key"] for x in less} == set(both[1:])
    monkeypatch.setattr(substring_dedup.Phrases, "places", lambda self, words: np.zeros(0, np.int64))
    assert located(both) == []


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(9)
    text = r.integers(0, 4, 3000).astype(np.uint64)
    text[2000:2200] = text[100:300]
    runs = winnow.runs(text, np.array([0, 1500, 3000]), 50, 10)
    cover = {}
    for t, s, n, a, k in zip(runs.text.tolist(), runs.start.tolist(), runs.count.tolist(), runs.anchor.tolist(), runs.key.tolist()):
        for w in range(s, s + n):
            cover[t, w] = (a - w, k)
    assert len(cover) == 2 * (1500 - 49)
    for d in range(150):
        assert cover[0, 100 + d] == cover[1, 500 + d]


def test_hashes_and_minima_against_loops():
    x = np.arange(40, dtype=np.uint64) ** np.uint64(3)
    for k in (1, 2, 5, 10, 13, 40):
        h = window_hashes(np.concatenate([x, x]), k, 12345)
        assert len(h) == 81 - k and (h[: 41 - k] == h[40:]).all() and len(np.unique(h[:40])) == 40
        assert (sliding_min(x[::-1].copy(), k) == [x[::-1][i : i + k].min() for i in range(41 - k)]).all()
    assert len(window_hashes(x, 41, 3)) == 0
