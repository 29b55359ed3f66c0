"""Phrase collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, 6):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = set()
        for p, a in some.items():
            for m in range(2, len(p)):
                inside |= {p[i : i + m] for i in range(len(p) - m + 1) if a >= f[p[i : i + m]]}
        best = []
        for p, a in some.items():
            if p not in inside:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                text = " ".join(p)
                best.append((-score, -a, text.encode(), text, f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, text, -a, x, y, total[lang], -s) for i, (s, a, _, text, x, y) in enumerate(sorted(best)[:top])]
    return sorted(out)


def made():
    r = random.Random(8)
    words = ["the", "of", "The", "été", "a-b", "日本", "x'y", "ÑU", "\x00z", "\x85", " ", *(f"w{i}" for i in range(40))]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(None, "en"), ("", "en"), ("  \t ..;,", "en"), ("one", None), ("a a a a a a a a a a a a", "en"), ("b b b b b b b b b b", ""), ("of the of the " * 3000, "en")]
    for _ in range(250):
        n = r.randint(1, 60)
        rows.append(("".join(w + r.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", " ;"]) for w in r.choices(words, weights, k=n)), r.choice(["en", "en", "de", None])))
    return rows + [("very long fixed phrase here", "en")] * 9 + [("long fixed phrase", "de")] * 6


# one bucket for all words; few buckets, shared by words; hot pivots over many shards; production tables
@pytest.mark.parametrize("least,top,bits,per_shard", [(4, 50, 1, 100), (3, 2000, 5, 40), (5, 2000, 22, 10), (6, 2000, 22, 500_000), (100, 3, 10, 1000)])
def test_collocations_equal_plain_counts(spark, least, top, bits, per_shard):
    rows = made()
    df = spark.createDataFrame([(*r, 1, "w", 2, 3) for r in rows], "text string, lang string, n long, word string, f long, shard long").repartition(5)
    got = collocations.collocations(df, least, top, bits, per_shard)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, top)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en"), ("a b", "en")], "text string, lang string")).count() == 0


def test_every_occurrence_is_in_one_fragment():
    r = np.random.default_rng(2)
    order = r.integers(0, 6, 400)
    piece = np.sort(r.integers(0, 60, 400))
    found = Counter()
    for p, a, b in zip(*(x.tolist() for x in collocations.fragments(order, piece, 4))):
        for x in range(a + 1):
            for y in range(b + 1):
                if 1 <= x + y <= 4:
                    found[p - x, p + y] += 1
    want = {(i, j): 1 for i in range(400) for j in range(i + 1, min(400, i + 5)) if piece[i] == piece[j] and (order[i : j + 1] > 0).all()}
    assert found == want
