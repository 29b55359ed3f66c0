"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded so that no node is kept under a dropped one.

The trees are trained here, on pages made by a rule (training_pages) whose parts are known. A node's features are its tag and
attribute words, those of its ancestors, the size and density of its subtree, its depth, and its siblings.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, text_bytes

# HTML's own element classes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title template iframe select".split())  # not text of the page
SWALLOW = frozenset("script style".split())  # without an end tag, all that follows is theirs
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption button label".split()
)
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}}

START = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[\"'>]")
WORDS_OF = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")

TAGS = {t: i for i, group in enumerate(("article main", "section div", "p blockquote pre", "h1 h2 h3 h4 h5 h6", "nav menu", "aside", "footer", "header", "form fieldset label button legend", "li ul ol dl dt dd", "table tbody tr td th thead tfoot caption", "figure figcaption")) for t in group.split()}
CONTENT_WORDS = frozenset("article content post entry story main body text page hentry prose blog news single articlebody".split())
OTHER_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer foot sidebar side aside widget ad ads advert advertisement adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe signup share sharing social related recommended more breadcrumb breadcrumbs pagination pager login search form toolbar topbar copyright legal disclaimer tags tagcloud trending popular outbrain taboola skip".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond discussion disqus thread reader responses".split())

N_FEATURES = 40


class Page:
    """Block nodes of a page in order, and its text in pieces, each with its node and whether a block boundary is before it."""

    def __init__(self, source: str):
        self.tag, self.words, self.parent, self.depth = ["#root"], [frozenset()], [-1], [0]
        self.pieces: list[tuple[int, str]] = []  # (node, text)
        self.links: list[int] = [0]
        self.inline: list[int] = [0]
        self.plain = True  # no block elements
        self._read(source)

    def _read(self, s: str) -> None:
        """One pass, in time linear in the page whatever it holds: what has been looked for to the end in vain is not looked for again."""
        stack: list[tuple[str, int]] = [("#root", 0)]  # open elements, with the block node they are in
        where: dict[str, list[int]] = {}  # places in the stack of each name
        blocks: list[int] = []  # and of block elements
        at, in_link = 0, 0
        run: list[str] = []  # text of the present block
        unclosed: set[str] = set()  # RAW elements without an end tag from here on
        quotes = {'"': True, "'": True}  # whether quotes of a kind can enclose any more

        def push(name: str, node: int) -> None:
            where.setdefault(name, []).append(len(stack))
            if name in BLOCKS:
                blocks.append(len(stack))
            stack.append((name, node))

        def cut(to: int) -> None:
            while len(stack) > to:
                name = stack.pop()[0]
                where[name].pop()
                if name in BLOCKS:
                    blocks.pop()

        def last(names: set[str]) -> int:
            return max((where[x][-1] for x in names if where.get(x)), default=0)

        def tag_end(begin: int) -> int:
            """The place of a tag's end, not in quotes; -1 if the page has none."""
            place = begin
            while True:
                m = STOP.search(s, place)
                if m is None:  # quotes hide every end: from here on they count for nothing
                    quotes.update({'"': False, "'": False})
                    return s.find(">", begin)
                if m[0] == ">":
                    return m.start()
                place = m.end()
                if quotes[m[0]]:
                    close = s.find(m[0], place)
                    if close < 0:
                        quotes[m[0]] = False
                    else:
                        place = close + 1

        def flush() -> None:
            if run:
                text = " ".join("".join(run).split())
                node = stack[-1][1]
                if text and not node:  # text in the root is judged as a paragraph of its own
                    node = len(self.tag)
                    self.tag.append("p")
                    self.words.append(frozenset())
                    self.parent.append(0)
                    self.depth.append(1)
                    for of in (self.links, self.inline):
                        of.append(of[0])
                        of[0] = 0
                if text:
                    self.pieces.append((node, text))
                run.clear()

        n = len(s)
        while at < n:
            m = START.search(s, at)
            begin = m.start() if m else n
            tag = m is not None and m[0][1] not in "!?"
            end = tag_end(begin + 1) if tag else begin
            if end < 0:  # no tag any more
                begin = n
            if begin > at:
                raw = s[at:begin]
                text = html.unescape(raw) if "&" in raw else raw
                run.append(text)
                if in_link:
                    self.links[stack[-1][1]] += len(text.strip())
            if begin == n:
                break
            if not tag:
                opening, closing = next(((a, b) for a, b in (("<!--", "-->"), ("<![CDATA[", "]]>")) if s.startswith(a, begin)), ("<!", ">"))
                end = s.find(closing, begin + len(opening))
                if opening == "<![CDATA[":
                    run.append(s[begin + 9 : end if end >= 0 else n])
                at = end + len(closing) if end >= 0 else n
                continue
            at = end + 1
            name = NAME.match(s, begin)[1]
            attributes = s[begin + 1 + len(name) : end]
            name = name.lower()
            if s[begin + 1] == "/":
                if where.get(name):
                    i = where[name][-1]
                    if blocks and blocks[-1] >= i:
                        flush()
                    cut(i)
                if name == "a":
                    in_link = 0
                continue
            if name in RAW:
                if not attributes.endswith("/"):
                    close = None if name in unclosed else re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(s, at)
                    if close:
                        end = s.find(">", close.end())
                        at = end + 1 if end >= 0 else n
                    elif name in SWALLOW:
                        at = n
                    else:
                        unclosed.add(name)
                continue
            if name in BLOCKS:
                flush()
                if name in ENDS:
                    i = last(ENDS[name])
                    if i > last(SCOPES[name]):
                        cut(i)
                elif blocks and stack[blocks[-1]][0] == "p":
                    cut(blocks[-1])
                if name == "hr":
                    continue
                node = len(self.tag)
                own = stack[-1][1]
                self.plain = False
                self.tag.append(name)
                self.words.append(frozenset(w for g in WORDS_OF.findall(attributes) for w in SPLIT.split("".join(g).lower()) if w) if attributes else frozenset())
                self.parent.append(own)
                self.depth.append(self.depth[own] + 1)
                self.links.append(0)
                self.inline.append(0)
                push(name, node)
                in_link = 0
            elif name == "br":
                run.append(" ")
            elif name not in VOID:
                self.inline[stack[-1][1]] += 1
                if not attributes.endswith("/"):
                    push(name, stack[-1][1])
                    in_link = 1 if name == "a" else in_link
        flush()

    def features(self) -> np.ndarray:
        n = len(self.tag)
        own, count, links = np.zeros(n), np.zeros(n), np.array(self.links, float)
        stops, words = np.zeros(n), np.zeros(n)
        for node, text in self.pieces:
            own[node] += len(text)
            count[node] += 1
            words[node] += text.count(" ") + 1
            stops[node] += text.count(". ") + text.count(", ") + text.endswith((".", "!", "?"))
        parent, depth = np.array(self.parent), np.array(self.depth)
        size, text, link, marks = np.ones(n), own.copy(), links.copy(), np.array(self.inline, float)
        for i in range(n - 1, 0, -1):  # parents come before their children
            p = self.parent[i]
            size[p] += size[i]
            text[p] += text[i]
            link[p] += link[i]
            marks[p] += marks[i]
        kids, order, same = np.zeros(n), np.zeros(n), np.zeros(n)
        kinds: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            p = self.parent[i]
            order[i] = kids[p]
            kids[p] += 1
            kinds[p, self.tag[i]] = kinds.get((p, self.tag[i]), 0) + 1
        x = np.zeros((n, N_FEATURES), np.float32)
        good, bad, said = np.zeros(n), np.zeros(n), np.zeros(n)
        up = np.zeros((n, 5))  # of ancestors: content words or tag, other words, comment words, other tags, form or list
        for i in range(n):
            w = self.words[i]
            good[i], bad[i], said[i] = len(w & CONTENT_WORDS), len(w & OTHER_WORDS), len(w & COMMENT_WORDS)
            kind = TAGS.get(self.tag[i], -1)
            if kind >= 0:
                x[i, kind] = 1
            if i:
                p = self.parent[i]
                same[i] = kinds[p, self.tag[i]]
                k = TAGS.get(self.tag[p], -1)
                up[i] = np.maximum(up[p], (float(good[p] > 0 or k == 0), float(bad[p] > 0), float(said[p] > 0), float(k in (4, 5, 6, 7)), float(k in (8, 9))))
        total = max(text[0], 1.0)
        x[:, 12:15] = np.stack([good, bad, said], 1)
        x[:, 15:20] = up
        x[:, 20] = depth
        x[:, 21] = np.log1p(own)
        x[:, 22] = np.log1p(text)
        x[:, 23] = text / total
        x[:, 24] = link / np.maximum(text, 1)
        x[:, 25] = text / (size + marks)
        x[:, 26] = size
        x[:, 27] = kids
        x[:, 28] = kids[parent]
        x[:, 29] = order / np.maximum(kids[parent], 1)
        x[:, 30] = same
        x[:, 31] = stops / np.maximum(words, 1)
        x[:, 32] = np.log1p(text[parent])
        x[:, 33] = text / np.maximum(text[parent], 1)
        x[:, 34] = link[parent] / np.maximum(text[parent], 1)
        x[:, 35] = words
        x[:, 36] = count
        before = np.roll(text, 1)
        after = np.roll(text, -1)
        x[:, 37], x[:, 38] = np.log1p(before), np.log1p(after)
        x[:, 39] = marks / size
        return x


class BoostedTrees:
    """Logistic gradient boosting with small trees on quantile bins."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature and limit of inner nodes, values of leaves

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            inner = (1 << self.depth) - 1
            feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
            at = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, nodes = (1 << level) - 1, 1 << level
                local, best = at - first, np.zeros(nodes)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    key = local * (len(c) + 1) + binned[:, f]
                    gs = np.bincount(key, g, nodes * (len(c) + 1)).reshape(nodes, -1).cumsum(1)
                    hs = np.bincount(key, h, nodes * (len(c) + 1)).reshape(nodes, -1).cumsum(1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    k = gain.argmax(1)
                    value = gain[np.arange(nodes), k]
                    better = value > best + 1e-9
                    best = np.where(better, value, best)
                    for j in np.flatnonzero(better):
                        feature[first + j], limit[first + j] = f, c[k[j]]
                at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > limit[at])
            leaf = at - inner
            values = self.rate * np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + self.ridge)
            self.trees.append((feature, limit, values))
            score = score + values[leaf]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, values in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            score += values[at - len(feature)]
        return score


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """The likeliest labels in which what is under a dropped node is dropped: one pass up, one down."""
    n = len(odds)
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    gone, best = drop.copy(), keep.copy()
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        gone[p] += gone[i]
        best[p] += max(best[i], gone[i])
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and best[i] >= gone[i]
    return kept


# ---------------------------------------------------------------- pages to learn from


def training_pages(number: int = 1500, seed: int = 3) -> Iterator[tuple[str, str]]:
    """(html, text of its kept marks) of pages made by rule: kept text has the mark k, other text the mark x in every word."""
    r = random.Random(seed)

    def prose(mark: str, low: int, high: int) -> str:
        out = []
        for i in range(r.randint(low, high)):
            w = mark + "".join(r.choice("aeiourstnl") for _ in range(r.randint(1, 9)))
            out.append(w.capitalize() if i and out[-1][-1] in ".!?" else w + r.choice(["", "", "", "", "", ",", ".", "."]))
        return " ".join(out)

    def links(n: int) -> str:
        style = r.random()
        items = [f'<a href="/{i}">{prose("x", 1, 4)}</a>' for i in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if style < 0.7 else r.choice([" ", " | "]).join(items)

    def attr(words: str, share: float = 0.85) -> str:
        if r.random() > share:
            return ""
        w = r.choice(words.split())
        return f' {r.choice(["class", "class", "id"])}="{r.choice(["", "", "site-", "the-", "c "])}{w}{r.choice(["", "", "-box", "-1", " clear"])}"'

    def other() -> str:
        kind = r.randrange(11)
        if kind == 0:
            return f"<nav{attr('menu nav main-nav', 0.4)}>{links(r.randint(3, 9))}</nav>"
        if kind == 1:
            return f"<div{attr('menu navbar navigation nav breadcrumb', 1)}>{links(r.randint(2, 9))}</div>"
        if kind == 2:
            return f"<div{attr('ad ads advert banner sponsor promo ad-slot', 1)}>{r.choice(['', '<p>'])}{prose('x', 2, 25)}</div>"
        if kind == 3:
            return f"<aside{attr('sidebar related widget', 0.5)}><h3>{prose('x', 1, 4)}</h3>{r.choice([links(4), '<p>' + prose('x', 5, 40) + '</p>'])}</aside>"
        if kind == 4:
            return f"<div{attr('sidebar side widget related popular', 1)}><h4>{prose('x', 1, 4)}</h4>{r.choice([links(4), '<p>' + prose('x', 5, 40) + '</p>'])}</div>"
        if kind == 5:
            return f"<form{attr('search login newsletter subscribe', 0.6)}><label>{prose('x', 1, 4)}</label><input type=text>{r.choice(['<p>' + prose('x', 3, 12) + '</p>', ''])}<button>{prose('x', 1, 2)}</button></form>"
        if kind == 6:
            return f"<div{attr('cookie cookie-notice consent notice alert popup newsletter', 1)}><p>{prose('x', 5, 30)}</p><button>{prose('x', 1, 1)}</button></div>"
        if kind == 7:
            n = r.randint(1, 6)
            body = "".join(r.choice([f"<div{attr('comment reply', 0.8)}><b>{prose('x', 1, 2)}</b><p>{prose('x', 3, 60)}</p></div>", f"<li><p>{prose('x', 3, 60)}</p></li>"]) for _ in range(n))
            return f"<{r.choice(['section', 'div'])}{attr('comments comment-list respond discussion commentlist', 1)}><h3>{prose('x', 1, 3)}</h3>{body}</{r.choice(['section', 'div'])}>"
        if kind == 8:
            return f"<div{attr('share social share-bar tags pagination', 1)}>{links(r.randint(2, 5))}</div>"
        if kind == 9:
            return f"<header{attr('header masthead top', 0.5)}>{r.choice(['<h1>' + prose('x', 1, 4) + '</h1>', '', '<p>' + prose('x', 2, 8) + '</p>'])}{r.choice([links(5), ''])}</header>"
        return f"<{(t := r.choice(['footer', 'footer', 'div']))}{attr('footer copyright legal disclaimer', 1 if t == 'div' else 0.3)}>{r.choice(['', '<p>'])}{prose('x', 2, 30)}{r.choice(['', links(4)])}</{t}>"

    def block() -> str:
        kind = r.random()
        if kind < 0.72:
            return f"<p>{r.choice(['', '', '', '<b>', '<em>'])}{prose('k', 1, r.choice([3, 20, 90]))}{r.choice(['</p>', '</p>', '</p>', '', '<br>'])}"
        if kind < 0.82:
            return f"<h{(h := r.randint(2, 4))}>{prose('k', 1, 8)}</h{h}>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{prose('k', 1, 25)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote>{r.choice(['', '<p>'])}{prose('k', 3, 40)}</blockquote>"
        if kind < 0.95:
            return "<table>" + "".join(f"<tr><td>{prose('k', 1, 6)}</td><td>{prose('k', 1, 6)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>"
        if kind < 0.97:
            return f"<pre>{prose('k', 2, 30)}</pre>"
        return f"<p>{prose('k', 2, 12)} <a href='/x'>{prose('k', 1, 4)}</a> {prose('k', 2, 12)}</p>"

    for _ in range(number):
        body = [f"<h1>{prose('k', 1, 10)}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.choice([0, 1, 1, 2, 4, 8, 16])):
            body.append(block())
            if r.random() < 0.06:
                body.append(other())
        form = r.random()
        if form < 0.55:
            kept = f"<article{attr('post entry story', 0.3)}>{''.join(body)}</article>"
        elif form < 0.7:
            kept = f"<main>{''.join(body)}</main>"
        elif form < 0.92:
            kept = f"<div{attr('content article post entry story main article-body', 1)}>{''.join(body)}</div>"
        else:
            kept = f"<div>{''.join(body)}</div>"
        if r.random() < 0.3:
            kept = f"<div{attr('container wrapper page main', 0.8)}>{kept}{other() if r.random() < 0.5 else ''}</div>"
        parts = [other() for _ in range(r.randint(0, 4))] + [kept] + [other() for _ in range(r.randint(0, 4))]
        yield "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(parts) + "</body></html>", ""


_MODEL: list[BoostedTrees] = []


def trained() -> BoostedTrees:
    """The trees, learnt once in each process that asks: a node is kept if its subtree has kept text."""
    if not _MODEL:
        xs, ys, weight = [], [], []
        for source, _ in training_pages():
            page = Page(source)
            n = len(page.tag)
            kept, lost = np.zeros(n), np.zeros(n)
            for node, text in page.pieces:
                kept[node] += text.lower().startswith("k")
                lost[node] += not text.lower().startswith("k")
            for i in range(n - 1, 0, -1):
                kept[page.parent[i]] += kept[i]
                lost[page.parent[i]] += lost[i]
            use = (kept + lost) > 0
            use[0] = False
            xs.append(page.features()[use])
            ys.append((kept > 0)[use])
        _MODEL.append(BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys).astype(float)))
    return _MODEL[0]


def extract(sources: list[str], model: BoostedTrees) -> list[str]:
    pages = [Page(s) for s in sources]
    sizes = [len(p.tag) for p in pages]
    if not pages:
        return []
    odds = np.split(model.log_odds(np.concatenate([p.features() for p in pages])), np.cumsum(sizes)[:-1])
    out = []
    for page, own in zip(pages, odds):
        kept = decode(page, own)
        out.append("\n\n".join(text for node, text in page.pieces if kept[node] or page.plain))
    return out


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page: kept blocks in page order, white space inside each one space, joined by a blank line.

    Null or empty html gives empty text. Each page by itself: a repeated row comes twice, other columns are not read. Pages of
    any length, malformed ones too, take time in proportion to it. An empty table gives no rows.
    """
    small_batches(pages.sparkSession, 400)
    model = trained()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = extract([(t or b"").decode("utf-8", "replace") for t in text_bytes(batch.column("html"))], model)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(rows, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
