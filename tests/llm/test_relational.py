"""Source divergence and near-duplicate classes against plain loops."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_dedup import brute_classes

from tessera.llm import divergence, minhash_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_audit(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)
        sources = sorted(s for g, s in groups if g == lang)
        p = {}
        for s in [*sources, None]:
            c = counts[lang, s] if s is not None else sum((counts[lang, x] for x in sources), Counter())
            n = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t])
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms[:top])]
    return sorted(out)


def audit_rows():
    r = random.Random(11)
    words = ["the", "The", "ÉTÉ", "été", "x1y", "a_b", "日本語", "😀z", "don't", "Zeta", "beta9gamma", "k", "\x00nul"]
    rows = [(None, None, None), ("", "en", "a"), ("12 34 --", "en", "b"), ("alone", "xx", "a"), ("apart", "xx", "b"), ("single", "yy", None), ("long " * 20000, "en", "a"), ("the", "", ""), ("the", None, "")]
    for i in range(60):
        rows.append((" ".join(r.choice(words[: 3 + i % 11]) for _ in range(r.randint(1, 40))), r.choice(["en", "de", None]), r.choice(["a", "b", "c", None, "Ä"])))
    return rows + rows[20:25]


@pytest.mark.parametrize("least,top", [(3, 200), (1, 2)])
def test_audit_equals_loops(spark, least, top):
    rows = audit_rows()
    df = spark.createDataFrame([(*r, 1, "t", 5, 7) for r in rows], "text string, lang string, source string, n long, term string, rank int, part int").repartition(3)
    got = divergence.audit_sources(df, least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows, least, top)


def test_audit_of_nothing(spark):
    assert divergence.audit_sources(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
    one = divergence.audit_sources(spark.createDataFrame([(None, None, None)], "text string, lang string, source string"))
    assert one.count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    cases = [(0, 1), (10**12, 10**12 + 5), (7 * 10**13, 9 * 10**15), (3, 7), (9 * 10**14, 9 * 10**14 + 1)]
    got = spark.createDataFrame(cases, "c long, d long").select("c", "d", divergence.share(F.col("c"), F.col("d")).alias("p")).collect()
    assert [(r["c"], r["d"], r["p"]) for r in got] == [(c, d, 1 + 10**9 * (c + 1) // d) for c, d in cases]


def plain_sketch(features, t):
    """The sketch by its definition: all rounds, a feature at a time."""
    out = [2**64 - 1] * t
    for i in range(2 * t):
        for x in features.tolist():
            h = int(minhash_dedup.mix(np.array([x ^ (minhash_dedup.SEED * (2 * i + 1) & (2**64 - 1))], np.uint64))[0])
            b = h % t if i < t else i - t
            out[b] = min(out[b], (i << minhash_dedup.VALUE_BITS) | h >> (64 - minhash_dedup.VALUE_BITS))
    return out


def test_sketches_fill_every_coordinate_and_equal_their_definition():
    r = np.random.default_rng(3)
    sets = [r.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 5, 0, 40, 400)]
    got = minhash_dedup.sketches(sets, 16)
    for s, row in zip(sets, got):
        assert not len(s) or row.tolist() == plain_sketch(s, 16)
    assert (got[[0, 1, 2, 4, 5]] != minhash_dedup.MASK).all() and (got[3] == minhash_dedup.MASK).all()


def test_agreement_estimates_similarity():
    r, errors = np.random.default_rng(4), []
    for n in (3, 10, 50, 300, 3000):
        for _ in range(40):
            base = r.integers(0, 2**63, 2 * n).astype(np.uint64)
            both = int(r.integers(0, n + 1))
            a, b = base[:n], base[n - both : 2 * n - both]
            x, y = minhash_dedup.sketches([a, b])
            errors.append((x == y).mean() - both / (2 * n - both))
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.2


def test_near_duplicates_equal_brute_force(docs, rows):
    got = minhash_dedup.near_duplicates(docs).collect()
    want = brute_classes(rows, 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_at_the_threshold_and_odd_ids(spark, no_docs):
    r, rows, n = random.Random(5), [], 0
    for size in (4, 5, 8, 9, 12, 20, 45, 90, 200, 401):
        words = [f"w{size}x{i}" for i in range(size)]
        for cut in (0, 1, 2, size // 10, size // 9, size // 9 + 1, size // 5):
            rows.append((n, " ".join(words[: size - cut] + [f"z{n}y{i}" for i in range(r.choice((0, cut)))])))
            n += 1
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows, 4)
    odd = [(5, "one text of five words"), (5, "one text of five words"), (None, "one text of five words"), (None, "only here without an id"), (7, "ONE text of five words"), (8, None), (9, " \t")]
    got = sorted(map(tuple, minhash_dedup.near_duplicates(spark.createDataFrame(odd, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (None, 2, None, True), (7, 2, 5, False), (8, 0, 8, True), (9, 0, 9, True)], key=str)
    assert minhash_dedup.near_duplicates(no_docs).count() == 0


def test_large_family_with_members_apart(spark):
    """A family around one text, beside members that link to each other but not to it."""
    r = random.Random(6)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for n in range(400):
        w = list(base)
        w[r.randrange(80)] = f"z{n}"
        rows.append((n, " ".join(w)))
    rows += [(1000 + n, " ".join(base[:60] + [f"q{n % 5}x{i}" for i in range(20)] + [f"e{n}"])) for n in range(60)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")["component_id"]
    assert got.to_dict() == {i: c for i, (_, c) in brute_classes(rows, 4).items()}
