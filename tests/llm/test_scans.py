from __future__ import annotations

import math
import random

import numpy as np
import pytest


from tessera.llm import decontamination, html_text, licenses, lm_scoring, nearest, toxicity

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def test_license_scan_equals_containment(spark, rows):
    r = random.Random(2)
    fill = lambda n: " ".join(r.choice("lorem ipsum dolor sit amet of the and".split()) for _ in range(n))
    texts = []
    for name, t in licenses.TEMPLATES:
        texts += [(name, fill(37) + "\n" + t + ".\n" + fill(23)), (name, t), (name, t.upper())]
    edited = licenses.TEMPLATES[4][1].split()
    edited[20] = "other"
    texts += [("MIT", fill(11) + " " + " ".join(edited) + " " + fill(9)), (None, fill(200)), (None, ""), (None, None), (None, "Licensed under")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = licenses.scan_licenses(df).toPandas()
    for i, (name, _) in enumerate(texts):
        own = got[got["doc_id"] == i]
        assert (name is None and own.empty) or name in set(own["license"])
    assert (got["containment"] >= 0.8).all()


def test_license_scan_of_odd_rows(docs, no_docs):
    assert licenses.scan_licenses(docs).count() == 0
    assert licenses.scan_licenses(no_docs).count() == 0


@pytest.fixture(scope="module")
def bench(spark):
    r = random.Random(3)
    items = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n)) + ". " + " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(6)) + ".") for i, n in enumerate((12, 20, 30, 45, 80, 25, 33))]
    return items


def test_leaks_are_found_and_clean_documents_left(spark, bench, rows):
    r = random.Random(4)
    clean = [(100 + i, " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(r.randint(1, 400)))) for i in range(60)]
    docs, want = list(clean), set()
    for i, t in bench:
        docs.append((1000 + i, clean[i][1] + " " + t + " " + clean[i + 10][1]))
        docs.append((2000 + i, t.upper()))
        w = t.split()
        for k in range(3, len(w) - 7, 6):
            w[k] = "other"
        docs.append((3000 + i, clean[i + 20][1] + "\n" + " ".join(w)))
        want |= {(1000 + i, i), (2000 + i, i), (3000 + i, i)}
    docs += [(r_[0] + 5000, r_[1]) for r_ in rows]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([*bench, (90, None), (91, ""), (None, "x y z")], "item_id long, text string")
    got = {(r_["doc_id"], r_["item_id"]) for r_ in decontamination.find_leaks(df, items).collect()}
    assert got == want


def test_leaks_in_slices_and_of_nothing(spark, bench, no_docs, monkeypatch):
    items = spark.createDataFrame(bench, "item_id long, text string")
    df = spark.createDataFrame([(i, "a b c " + t) for i, t in bench], "doc_id long, text string")
    monkeypatch.setattr(decontamination, "ITEM_BYTES", 300)
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(df, items).collect()} == {(i, i) for i, _ in bench}
    assert decontamination.find_leaks(no_docs, items).count() == 0
    assert decontamination.find_leaks(df, items.where("item_id < 0")).count() == 0


def test_paraphrases_at_all_places_of_the_grid(spark):
    """20 to 24 of 32 words in order are found at every offset where the answer is whole or they are 24; 17 without the answer are no leak."""
    r = random.Random(9)
    words = lambda n: ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    items, docs, want = [], [(9000 + i, " ".join(words(300))) for i in range(40)], set()
    for i in range(6):
        item = words(26)
        item[-1] += "."
        answer = words(6)
        answer[-1] += "."
        items.append((i, " ".join(item + answer)))
        for offset in range(16):
            for k, changed in enumerate((range(0, 26, 3), range(6, 18), range(12, 20), range(10, 24))):
                own = item + answer
                for j in changed:
                    own[j] = words(1)[0]
                if k == 3:
                    own[-1] = "other."
                doc = i * 1000 + offset * 10 + k
                docs.append((doc, " ".join(words(32 + offset) + own + words(40))))
                if k < 3:
                    want.add((doc, i))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r_["doc_id"], r_["item_id"]) for r_ in decontamination.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


def test_bounds_leave_out_no_common_subsequence():
    """Counts and covered places of blocks against whole subsequences, for items of up to several times 64 words; answers against plain search."""
    r = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 90, n)) + ". " + " ".join(f"w{x}" for x in r.integers(0, 90, m)) for n, m in ((5, 1), (30, 2), (63, 1), (64, 3), (65, 2), (200, 4))]
    items = decontamination.Items(list(range(6)), [t.encode() for t in texts], np.ones((decontamination.FEATURES, 2)))
    words = decontamination.numbers([" ".join(f"w{x}" for x in r.integers(0, 120, 1600)).encode()])[0]
    bounds = decontamination.Bounds(items)
    rows = decontamination._padded(bounds.rows(words), np.array([0, len(words)]), 0)[0]
    counts = bounds.counts(rows)
    for i, a in enumerate(items.words):
        for begin, end in ((0, 1), (3, 9), (40, 70), (0, 100)):
            common = decontamination.common_subsequence(a, words[16 * begin : 16 * end].tolist())
            covered = bounds.covered(rows, np.array([i]), np.array([begin]), np.array([end]))[0]
            assert common <= covered and common <= counts[end, i] - counts[begin, i]
    want = [(i << 40) + p for i, a in enumerate(items.answers) for p in range(len(words)) if words[p : p + len(a)].tolist() == a.tolist()]
    assert bounds.places(bounds.rows(words)).tolist() == want and want


def test_common_subsequence_against_table():
    r = np.random.default_rng(1)
    for _ in range(60):
        a, b = r.integers(0, 5, r.integers(0, 30)).tolist(), r.integers(0, 5, r.integers(0, 40)).tolist()
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontamination.common_subsequence(a, b) == t[-1][-1]


def test_lm_scores_equal_plain_counts_on_both_paths(spark, docs, rows, no_docs):
    from tessera.llm.tokens import WordTokens

    t = WordTokens(TOKENIZER)
    targets = spark.createDataFrame([(i,) for i in (6, 10, 20, 20, None)], "doc_id long")
    ids = {r[0]: t.encode([(r[1] or "").encode()])[0].tolist() for r in rows}
    start, v = t.size, t.size
    pair, after, one = ({}, {}), ({}, {}), ({}, {})
    for i, own in ids.items():
        for m in (0, 1) if i in (6, 10, 20) else (1,):
            for a, b in zip([start, *own], own):
                pair[m][a, b] = pair[m].get((a, b), 0) + 1
                after[m][a] = after[m].get(a, 0) + 1
                one[m][b] = one[m].get(b, 0) + 1
    for held in (10**9, 0):
        got = lm_scoring.score_documents(docs, targets, TOKENIZER, held).toPandas().set_index("doc_id")
        assert len(got) == len(rows)
        for i, own in ids.items():
            loss = []
            for m in (0, 1):
                n = sum(one[m].values()) + v + 1
                p = [(pair[m].get((a, b), 0) + lm_scoring.MASS * (one[m].get(b, 0) + 1) / n) / (after[m].get(a, 0) + lm_scoring.MASS) for a, b in zip([start, *own], own)]
                loss.append(-sum(map(math.log, p)) / max(1, len(p)))
            assert got.loc[i, "n_tokens"] == len(own)
            assert abs(got.loc[i, "loss_target"] - loss[0]) < 1e-6 and abs(got.loc[i, "loss_background"] - loss[1]) < 1e-6
            assert abs(got.loc[i, "score"] - (loss[0] - loss[1])) < 1e-6
    assert lm_scoring.score_documents(no_docs, targets, TOKENIZER).count() == 0


@pytest.fixture(scope="module")
def labelled():
    r = random.Random(5)
    bad = "vilefool rottencad dimwitted scoundrelly".split()
    out = []
    for i in range(900):
        words = ["".join(r.choice(("th", "an", "er", "on", "re", "st", "ou")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(30, 200))]
        y = int(r.random() < 0.3)
        if y:
            for _ in range(max(3, len(words) // 15)):
                words[r.randrange(len(words))] = r.choice(bad)
        out.append((i, " ".join(words), y))
    return out


def test_toxicity_on_held_out_rows(spark, labelled, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled] + [(10_000 + r[0], r[1]) for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled] + [(10_001, None)], "doc_id long, toxic int")
    model = toxicity.train_on(docs, labels)
    got = toxicity.score_toxicity(docs, model).select("*", toxicity.is_held_out().alias("out")).toPandas().set_index("doc_id")
    out = [(y, got.loc[i, "toxic"]) for i, _, y in labelled if got.loc[i, "out"]]
    assert len(out) > 100 and sum(y == p for y, p in out) / len(out) > 0.95
    assert got["toxicity"].between(0, 1).all() and len(got) == len(labelled) + len(rows)


def test_toxicity_compresses_a_window_no_oftener_than_needed(labelled, monkeypatch):
    """A repeated window once; with the toxic dictionary only what ordinary text leaves unexplained; the same alone as with others."""
    seen, make = [], toxicity.compressor

    def counted(dictionary):
        compress = make(dictionary)
        return lambda w: seen.append((dictionary, w)) or compress(w)

    ends = [[w for _, t, y in labelled[:600] if y == k for w in toxicity.windows(t.encode())] for k in (1, 0)]
    dicts = toxicity.dictionaries(*ends)
    monkeypatch.setattr(toxicity, "compressor", counted)
    monkeypatch.setattr(toxicity, "_HELD", {})
    texts = [t.encode() for _, t, _ in labelled[600:]] * 2 + [b"", b" ", labelled[0][1].encode() * 3]
    got = toxicity.features(texts, *dicts)
    every = {w for t in texts for w in toxicity.windows(t)}
    by = [[w for d, w in seen if d == k] for k in dicts[:2]]
    assert len(by[1]) == len(every) and set(by[1]) == every
    assert len(by[0]) == len(set(by[0])) < 0.8 * len(every)
    slope, least = dicts[2]
    ordinary, toxic = make(dicts[1]), make(dicts[0])
    for t, row in zip(texts, got):
        own = toxicity.windows(t)
        apart = [min(max(len(ordinary(w)) - len(toxic(w)), 0), toxicity.TOP) if len(ordinary(w)) >= slope * len(w) + least else 0 for w in own]
        assert toxicity.distances([t], *dicts)[0].tolist() == apart
        assert np.allclose(row[2 * toxicity.TOP : 3 * toxicity.TOP], [math.log1p(sum(a >= k for a in apart)) for k in range(1, toxicity.TOP + 1)])
        assert (toxicity.features([t], *dicts)[0] == row).all()


def test_toxicity_without_labels(spark, docs, no_docs, rows):
    model = toxicity.train_on(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model is None
    got = toxicity.score_toxicity(docs, model)
    assert got.count() == len(rows) and got.where("toxicity <> 0 or toxic <> 0").count() == 0
    assert toxicity.score_toxicity(no_docs, model).count() == 0


def test_neighbours_recall_and_ties(spark):
    r = np.random.default_rng(6)
    x = r.standard_normal((1200, 16)).astype(np.float32)
    x[100:160] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5050, []), (5100, [0.0] * 16), (5150, [float("nan")] * 16), (5200, [None] + [1.0] * 15), (5250, [float("inf")] * 16), (5300, [1.0, 2.0]), (5350, [2.0, 4.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = nearest.nearest_neighbours(df, df.where("vec_id % 50 = 0")).toPandas()
    d = x.astype(float)
    n = np.sqrt((d * d).sum(1))
    hit = total = 0
    for q, own in got[got["query_id"] < 5000].groupby("query_id"):
        cos = d @ d[q] / (n * n[q])
        cos[q] = -9
        best = np.lexsort((np.arange(len(d)), -np.round(cos, 12)))[:5]
        hit += len(set(best) & set(own["vec_id"]))
        total += 5
        assert own.sort_values("rank")["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(own["score"], cos[own["vec_id"]], atol=1e-12)
    assert total == 24 * 5 and hit / total >= 0.9
    assert got[got["query_id"] == 100].sort_values("rank")["vec_id"].tolist() == [3, 101, 102, 103, 104]
    assert got[got["query_id"] == 5300]["vec_id"].tolist() == [5350]
    assert set(got["query_id"]) & {5000, 5050, 5100, 5150, 5200, 5250} == set()


def test_neighbours_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(7)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.standard_normal((400, 8)))], "vec_id long, embedding array<double>")
    q = df.where("vec_id % 10 = 0")
    whole = nearest.nearest_neighbours(df, q).toPandas()
    monkeypatch.setattr(nearest, "BLOCK", 40)
    monkeypatch.setattr(nearest, "QUERIES", 15)
    for regions in (1024, 3):  # 3: regions of several blocks
        monkeypatch.setattr(nearest, "REGIONS", regions)
        parts = nearest.nearest_neighbours(df, q).toPandas()
        same = len(set(zip(whole["query_id"], whole["vec_id"])) & set(zip(parts["query_id"], parts["vec_id"])))
        assert len(whole) == len(parts) == 200 and same >= 180
    assert nearest.nearest_neighbours(df, df.where("vec_id < 0")).count() == 0


def test_repeated_vectors(spark):
    """A row that comes twice, asked or not, counts once."""
    r = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(r.standard_normal((60, 8)))]
    once = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    twice = spark.createDataFrame(rows + rows[:30] + [rows[0]], "vec_id long, embedding array<double>")
    get = lambda df: [tuple(x) for x in nearest.nearest_neighbours(df, df.where("vec_id % 10 = 0")).orderBy("query_id", "rank").collect()]
    assert get(once) == get(twice)


def test_chi_square():
    assert abs(nearest.chi_square_quantile(0.95, 2) - 5.991465) < 1e-5
    assert abs(nearest.chi_square_quantile(0.95, 8) - 15.507313) < 1e-5


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News &amp; more</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div>
<aside class="sidebar"><h3>Related</h3><p>Other story to read.</p></aside>
<article><h1>A title &amp; more</h1><p><b>First  line<br>goes on.<p>Second&nbsp;one.</p><ul><li>Item one of the text.</li><li>Item two.</li></ul></article>
<div id="comments"><p>I was first to say something here.</p></div><form><label>Name</label></form><footer>Imprint and legal notes.</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.extract([PAGE], html_text.trained()) == ["A title & more\n\nFirst line goes on.\n\nSecond one.\n\nItem one of the text.\n\nItem two."]


def test_pages_of_all_kinds(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "plain"), (4, "u", PAGE), (4, "u", PAGE), (5, "u", "<p>unclosed <b>text <!-- never ends"), (6, "u", "<article><p>" + "word " * 50_000 + "</article>"), (7, "u", "<<<>>&&&;</p></div>"), (8, "u", "<div " * 3000)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "page_id long, url string, html string, text string, n_chars double")
    got = html_text.extract_pages(df).toPandas()
    assert len(got) == len(rows) and (got["n_chars"] == got["text"].str.len()).all()
    by = got.set_index("page_id")["text"]
    assert by[1] == by[2] == "" and by[3] == "plain" and by[6] == ("word " * 50_000).strip()
    assert html_text.extract_pages(df.where("page_id > 90")).count() == 0


def test_text_in_the_root_and_after_unclosed_elements():
    say = "The first of the long lines of this story, which goes on for a while and ends here."
    more = "A second paragraph tells what came of it, and why nobody had seen it coming."
    model = html_text.trained()
    pages = [f"{say} <p>{more}</p>", f"<html><body><article><p>{more}</p></article></body></html>{say}", *(f"<article><p>{say}</p><{t}><p>{more}</p></article>" for t in ("svg", "object", "video", "select", "noscript"))]
    for page, text in zip(pages, html_text.extract(pages, model)):
        assert say in text and more in text, page
    assert html_text.extract([f"<p>{say}</p><script>{more}", f"{say}<b> and</b> so on"], model) == [say, f"{say} and so on"]
    assert html_text.Page("<select>" * 20_000 + "<p>end</p>").pieces == [(1, "end")]
    assert html_text.extract([f"<article><p>{say} <math><mi>x</mi></math> is so.</p><p>{more}</p></article>"], model) == [f"{say} x is so.\n\n{more}"]


def test_hostile_pages_take_linear_time():
    import time

    n = 100_000
    for part in ("<a ", '<a "', '<a ">" ', "</svg ", "</b>", "<b></i>", "<div></p>", "<b><div></div>", "<div><li></li>", "<!--", "<select></select ", "<p><b>", "&#", "<td><tr>", "<![CDATA[", "<!"):
        began = time.time()
        html_text.Page("<div>" * 5_000 + part * n)
        assert time.time() - began < 20, part


def test_nothing_is_kept_under_a_dropped_node():
    page = html_text.Page(PAGE)
    r = np.random.default_rng(1)
    for _ in range(50):
        odds = r.normal(0, 3, len(page.tag))
        kept = html_text.decode(page, odds)
        assert all(kept[page.parent[i]] or not kept[i] for i in range(1, len(kept)))
