"""Jaccard self-join of documents on word shingles, with PartEnum signatures.

Sets within a size band differ in at most k features if they are similar enough. The feature domain is dealt into first-level
partitions and each of these into second-level ones. Of two such sets some first-level partitions hold few differences, and
there all subsets of second-level partitions of one size are enumerated: one of them has no difference, so its features are a
shared signature. Equal sets are one class from the start, and only one document of each makes signatures. The classes that
share a signature are first compared with the smallest of them, their hub, which is linear; only in groups that are then still
of several components are members compared with each other. Bounds from bucket counts go before texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, grouped_batches, materialize, mix, settle, signed, small_batches, sorted_groups, text_bytes, text_chunks, window_hashes, with_group, word_hashes
from .components import connected_components

SHINGLE = 5
NUM, DEN = 80, 100  # linked if DEN * intersection >= NUM * union
BAND = 1.5  # a band's largest size over its smallest
BASE = 0x9E3779B97F4A7C15
KEYS = ["hub", "kind", "i", "j"]
Sign = Callable[[list[np.ndarray]], list[np.ndarray]]  # signatures of each set
BLOCK = 384  # members of a hub in one block; a task compares two blocks
STAR = 256  # members of a hub that one task compares with it


def bands(size: int, num: int = NUM, den: int = DEN, ratio: float = BAND) -> list[tuple[int, int]]:
    """(band, its largest size) of every band in which a set of this size can have a partner.

    Band edges are the same for all. A pair goes by its larger set's band: a set is in its own band, and in the next if a
    partner of size up to size * den / num reaches it.
    """
    out, low, band = [], 1, 0
    while True:
        high = max(low, int(low * ratio))
        if low <= size * den // num and size <= high:
            out.append((band, high))
        if low > size * den // num:
            return out
        low, band = high + 1, band + 1


class Scheme(NamedTuple):
    """Of n1 first-level partitions at least `sure` hold k2 differences or fewer; each has n2 second-level ones."""

    n1: int
    n2: int
    k2: int
    sure: int


def differences(high: int, num: int = NUM, den: int = DEN) -> int:
    """The most features in which linked sets of at most `high` differ: |A - B| + |B - A| <= (den - num) / (den + num) * (|A| + |B|)."""
    return (den - num) * 2 * high // (den + num)


def scheme(k: int) -> Scheme:
    """k2 + 1 differences or more are in k // (k2 + 1) first-level partitions at most; some more than these make empty subsets rare."""
    if k < 4:
        return Scheme(1, k + 3 if k else 1, k, 1)
    if k < 12:
        return Scheme(k // 3 + 1, 5, 2, 1)
    more = max(2, k // 24)
    return Scheme(k // 2 + 1 + more, 3, 1, 1 + more)


def single(k: int) -> Scheme:
    """One level only: subsets are whole partitions, of which more than k are filled even in a band's smallest sets."""
    n = k + 4 + 3 * k // 10
    return Scheme(n, 1, 0, n - k)


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct hashed k-word shingles, sorted; of fewer words the whole sequence is one; none of no words."""
    words, offsets = word_hashes([t.lower() for t in texts])
    every = window_hashes(words, k, BASE)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        elif b > a:
            out.append(window_hashes(words[a:b], b - a, BASE) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], num: int = NUM, den: int = DEN) -> list[np.ndarray]:
    """PartEnum signatures of each set, for each band of it: hashes of its features in each enumerated subset of partitions.

    A subset without features gives none. If less than `sure` first-level partitions of one of two linked sets have such a
    subset, a signature with features is shared; sets with as many of them (few, small ones mostly) also give signatures of one
    level, where, of those with as many empty partitions again, empty ones count too.
    """
    own = [(i, band, differences(high, num, den)) for i, s in enumerate(sets) if len(s) for band, high in bands(len(s), num, den)]
    out: list[list[np.ndarray]] = [[] for _ in sets]
    for level, how in enumerate((scheme, single)):
        left = []
        for task, sig, filled in _subsets([(i, band, k, sets[i], how(k)) for i, band, k in own], level):
            sparse = int((~filled).any(1).sum()) >= task[4].sure
            out[task[0]].append(sig.ravel() if level and sparse else sig[filled])
            if sparse:
                left.append(task[:3])
        own = left
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


def _subsets(tasks: list[tuple], level: int) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """For each (set's number, band, k, features, scheme): hashes of its features in each first-level partition (rows) and subset, and which have features."""
    if not tasks:
        return
    sizes = np.array([len(t[3]) for t in tasks])
    n1, n2 = (np.array([getattr(t[4], x) for t in tasks], np.int64) for x in ("n1", "n2"))
    first = np.concatenate([[0], np.cumsum(n1 * n2)])
    features = np.concatenate([t[3] for t in tasks])
    spread = mix(features ^ np.uint64(0x5851F42D4C957F2D))
    cell = ((spread >> np.uint64(20)) % np.repeat(n1 * n2, sizes).astype(np.uint64)).astype(np.int64) + np.repeat(first[:-1], sizes)
    part = np.uint64(0x3FFFFFF)  # sums of 26 bits are exact in doubles
    sums = [np.bincount(cell, (x & part).astype(np.float64), first[-1]) for x in (spread, mix(spread), features >> np.uint64(7))]
    sums.append(np.bincount(cell, minlength=first[-1]).astype(np.float64))
    for j, task in enumerate(tasks):
        n = task[4]
        chosen = np.array(list(combinations(range(n.n2), n.n2 - n.k2)), np.int64)
        low, high, more, count = (x[first[j] : first[j + 1]].reshape(n.n1, n.n2)[:, chosen].sum(2) for x in sums)
        place = np.arange(low.size, dtype=np.uint64).reshape(low.shape) | np.uint64(task[1] * 2 + level) << np.uint64(32)
        yield task, mix(low.astype(np.uint64) + mix(high.astype(np.uint64) + mix(more.astype(np.uint64) + mix(place)))), count > 0


def _set_ids(sets: list[np.ndarray]) -> list[int]:
    return [int(mix(mix(s).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(s))).view(np.int64)[0]) for s in sets]


def bucket_counts(s: np.ndarray) -> bytes:
    """Features in each part of the domain, at most 255: a power of two of parts, with 4 to 8 features each on average.

    The sum of differences is a lower bound of the symmetric difference; folding neighbours gives the counts of half as many parts.
    """
    bits = max(0, len(s) // 4).bit_length()
    return np.minimum(np.bincount((mix(s) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(s), np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def possible(sizes: np.ndarray, counts: list[bytes], num: int = NUM, den: int = DEN) -> np.ndarray:
    """Which pairs sizes and bucket counts leave (upper triangle): a condition that every linked pair meets."""
    m = len(sizes)
    out = np.zeros((m, m), bool)
    rows = [np.frombuffer(c, np.uint8) for c in counts]
    width = np.array([len(r) for r in rows])
    cut = np.array([r.max(initial=0) == 255 for r in rows])
    limit = (sizes[:, None] + sizes[None, :]) * (den - num)
    fit = np.triu((np.minimum.outer(sizes, sizes) * den >= np.maximum.outer(sizes, sizes) * num) & (np.minimum.outer(sizes, sizes) > 0), 1)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width >= w)
        folded = np.stack([rows[i].reshape(w, -1).sum(1, dtype=np.int32) for i in own])
        for j, i in enumerate(own.tolist()):
            later = np.flatnonzero(fit[i, own] & (np.minimum(width[i], width[own]) == w))
            if len(later):
                differ = np.abs(folded[later] - folded[j]).sum(1)
                to = own[later]
                folds = (width[to] != width[i]) & (cut[to] | cut[i])  # cut counts can't be folded
                out[i, to] = folds | (differ * (den + num) <= limit[i, to])
    return out


SETS = "doc_id long, n_shingles long, set_id long, counts binary"


def _lists(arrays: list[np.ndarray], kind: type) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(kind, copy=False)))


def _set_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_chunks(batches):
        sets = shingle_sets(texts, shingle)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(_set_ids(sets), pa.int64()), pa.array([bucket_counts(s) for s in sets], pa.binary())],
            names=[c.split()[0] for c in SETS.split(", ")],
        )


def _signed_rows(batches: Iterator[pa.RecordBatch], shingle: int, sign: Sign) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_chunks(batches):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists([signed(x) for x in sign(shingle_sets(texts, shingle))], np.int64)], names=["rep", "sigs"])


def linked(a: np.ndarray, b: np.ndarray, num: int = NUM, den: int = DEN) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(len(a) and len(b)) and den * both >= num * (len(a) + len(b) - both)


def _in_blocks(members: DataFrame) -> DataFrame:
    """(hub, rep, comp, block, kind, i, j) of members (hub, rep, comp): each once for every two blocks of its hub that it is compared in.

    Members of a hub's commonest component (block -1) need none of each other: they meet the others only (kind 0, their block i
    with block j of the others), and the others each other (kind 1).
    """
    most = members.groupBy("hub", "comp").agg(F.count("*").alias("same")).groupBy("hub").agg(F.max(F.struct("same", "comp")).alias("most"), F.sum("same").alias("all"))
    rows = with_group(members, ["hub"], "rep", [], also=lambda groups: groups.join(most, "hub"))
    main, count = F.col("comp") == F.col("most.comp"), lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("long")
    mains, others = count(F.col("most.same")), count(F.col("all") - F.col("most.same"))
    own = F.pmod(F.xxhash64("rep"), F.when(main, mains).otherwise(others))
    pair = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), f)
    across = F.concat(each(mains, lambda k: pair(0, k, own)), each(others, lambda k: pair(1, F.least(own, k), F.greatest(own, k))))
    pairs = F.when(main, each(others, lambda k: pair(0, own, k))).otherwise(across)
    return rows.withColumns({"block": F.when(main, F.lit(-1).cast("long")).otherwise(own), "pair": F.explode(pairs)}).drop("most", "all").select("*", "pair.*").drop("pair")


def possible_rows(n: np.ndarray, counts: list[bytes], hub_n: np.ndarray, hub_counts: list[bytes], num: int = NUM, den: int = DEN) -> np.ndarray:
    """possible() of each row's two sets."""
    out = (np.minimum(n, hub_n) * den >= np.maximum(n, hub_n) * num) & (np.minimum(n, hub_n) > 0)
    width, hub_width = np.array([len(c) for c in counts]), np.array([len(c) for c in hub_counts])
    for w, v in np.unique(np.stack([width[out], hub_width[out]], 1), axis=0).tolist():
        own = np.flatnonzero(out & (width == w) & (hub_width == v))
        a, b = (np.frombuffer(b"".join([x[i] for i in own.tolist()]), np.uint8).reshape(len(own), -1).astype(np.int32) for x in (counts, hub_counts))
        cut = (w != v) & ((a.max(1, initial=0) == 255) | (b.max(1, initial=0) == 255))
        least = min(w, v)
        differ = np.abs(a.reshape(len(own), least, -1).sum(2) - b.reshape(len(own), least, -1).sum(2)).sum(1)
        out[own] = cut | (differ * (den + num) <= (n[own] + hub_n[own]) * (den - num))
    return out


def _beside_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members and hubs that may be linked."""
    for b in batches:
        maybe = possible_rows(b.column("n").to_numpy(), b.column("counts").to_pylist(), b.column("hub_n").to_numpy(), b.column("hub_counts").to_pylist())
        yield b.filter(pa.array(maybe)).select(["hub_rep", "rep"])


def _star_links(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Links of each hub with the members beside it; the hub's row comes first."""
    for group in grouped_batches(batches, ["hub", "part"]):
        sets = shingle_sets([t or b"" for t in text_bytes(group.column("text"))], shingle)
        ids, first = group.column("rep").to_pylist(), group.column("first").to_pylist()
        if first[0]:
            out = [(ids[0], i) for i, s, f in zip(ids, sets, first) if not f and linked(sets[0], s)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])


def _compare_with_hubs(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Links (a, b) between the members and the hub of each (hub, rep): first by bounds, then by texts."""
    hub = classes.select(F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("counts").alias("hub_counts"))
    rows = with_group(pairs, ["hub"], "rep", [], also=lambda groups: groups.join(hub, "hub"))
    rows = rows.join(classes, "rep").select(F.col("hub").alias("hub_rep"), "rep", "n", "counts", "hub_n", "hub_counts")
    left = materialize(rows.mapInArrow(_beside_hub, "hub_rep long, rep long").distinct(), "beside")
    settle(docs.sparkSession)
    left = with_group(left, ["hub_rep"], "rep", [F.ceil(F.count("*") / STAR).cast("long").alias("parts")]).select(F.col("hub_rep").alias("hub"), F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part"), "rep")
    rows = left.select("*", F.lit(False).alias("first")).unionAll(left.select("hub", "part", F.col("hub").alias("rep"), F.lit(True).alias("first")).distinct())
    # a merge join at every size: what is left grows with the documents
    rows = rows.join(docs.hint("merge"), F.col("rep") == F.col("doc_id")).select("hub", "part", "first", "rep", "text")
    rows = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", F.desc("first"))
    links = materialize(rows.mapInArrow(partial(_star_links, shingle=shingle), "a long, b long"), "links")
    settle(docs.sparkSession)
    return links


def _apart(group: pa.Table, maybe: np.ndarray) -> np.ndarray:
    """Only pairs of different components; of two different blocks, or of the commonest component and others, only pairs across."""
    comp = group.column("comp").to_numpy()
    maybe &= comp[:, None] != comp[None, :]
    if group.column("kind")[0].as_py() == 0 or group.column("i")[0] != group.column("j")[0]:
        block = group.column("block").to_numpy()
        maybe &= block[:, None] != block[None, :]
    return maybe


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each two blocks, the members that may be linked with one of the other (or, in one block, with another)."""
    for group in grouped_batches(batches, KEYS):
        if group.num_rows > 1:
            maybe = _apart(group, possible(group.column("n").to_numpy(), group.column("counts").to_pylist()))
            some = group.filter(pa.array(maybe.any(0) | maybe.any(1))).select(["hub", "rep", "comp"])
            yield from some.combine_chunks().to_batches()


def _links(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Links of each two blocks' texts, but for those between members that others join already."""
    for group in grouped_batches(batches, KEYS):
        sets = shingle_sets([t or b"" for t in text_bytes(group.column("text"))], shingle)
        ids = group.column("rep").to_pylist()
        maybe = _apart(group, possible(np.array([len(s) for s in sets], np.int64), [bucket_counts(s) for s in sets]))
        root, out = np.unique(group.column("comp").to_numpy(), return_inverse=True)[1], []
        for x, y in np.argwhere(maybe).tolist():
            if root[x] != root[y] and linked(sets[x], sets[y]):
                out.append((ids[x], ids[y]))
                root[root == root[y]] = root[x]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])


def _groups(signed_: DataFrame) -> DataFrame:
    """(hub, rep) of all sets, by their document, that share a signature with a smaller one; hub is the smallest that has it.

    The window streams over sorted rows and keeps none.
    """
    w = Window.partitionBy("sig").orderBy("rep").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = signed_.select(F.explode("sigs").alias("sig"), "rep").withColumn("hub", F.min("rep").over(w))
    return rows.where("rep <> hub").select("hub", "rep").distinct()


def _compare(members: DataFrame, known: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Links (a, b) between members (hub, rep) of a hub that are in different components as known: first by bounds, then by texts."""
    rows = _in_blocks(members.join(known.select("rep", "comp"), "rep").select("hub", "rep", "comp")).join(known.select("rep", "n", "counts"), "rep")
    left = sorted_groups(rows, KEYS).mapInArrow(_candidates, "hub long, rep long, comp long").distinct()
    left = materialize(left, "left")
    settle(docs.sparkSession)
    # a merge join at every size: what is left grows with the documents
    rows = _in_blocks(left).join(docs.hint("merge"), F.col("rep") == F.col("doc_id")).select(*KEYS, "block", "rep", "comp", "text")
    links = materialize(sorted_groups(rows, KEYS).mapInArrow(partial(_links, shingle=shingle), "a long, b long"), "links")
    settle(docs.sparkSession)
    return links


def jaccard_classes(docs: DataFrame, shingle: int = SHINGLE, sign: Sign = signatures) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that links reach, itself included).

    ASCII letters are lower-cased, words are [^\\x20\\x09-\\x0D]+, a document's set is its distinct shingles of 5 words (fewer words: the
    whole sequence). `sign` gives each set's signatures, PartEnum's unless told otherwise. Documents without words or with null text have the empty set and link with nothing. Every pair that
    shares a signature is compared, or is in one component by other links. Shingles and sets go by 64-bit hashes. doc_id is a key; a
    repeated row comes twice, a null id gets its text's class, null if no document of known id has it. Extra columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    facts = materialize(docs.mapInArrow(partial(_set_rows, shingle=shingle), SETS), "facts")
    # equal sets are one class, shown by its smallest document
    classes = facts.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("counts").alias("counts"))
    classes = materialize(classes, "classes")
    named = classes.select("rep", "n", "counts").where("rep is not null")
    shown = docs.hint("merge").join(named.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    pairs = materialize(_groups(shown.mapInArrow(partial(_signed_rows, shingle=shingle, sign=sign), "rep long, sigs array<long>")), "pairs")
    settle(spark)
    links = _compare_with_hubs(pairs, named, docs, shingle)
    nodes = materialize(connected_components(links, "a", "b"), "nodes")
    known = named.join(nodes, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("component_id", "rep")).drop("node", "component_id")
    known = materialize(known, "known")
    settle(spark)
    # then members of one hub that are still in different components
    members = pairs.unionAll(pairs.select("hub", F.col("hub").alias("rep")).distinct()).join(known.select("rep", "comp"), "rep")
    members = with_group(members, ["hub"], "rep", [F.min("comp").alias("lo"), F.max("comp").alias("hi")], "lo < hi").select("hub", "rep")
    more = _compare(members, known, docs, shingle)
    nodes = connected_components(links.unionAll(more), "a", "b")
    comps = classes.join(nodes, F.col("rep") == F.col("node"), "left").select("set_id", F.coalesce("component_id", "rep").alias("comp"))
    out = with_group(facts.where("n_shingles > 0").select("doc_id", "n_shingles", "set_id"), ["set_id"], "doc_id", [], also=lambda groups: groups.join(comps, "set_id"))
    out = out.select("doc_id", "n_shingles", F.col("comp").alias("component_id")).unionAll(facts.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    for table in (pairs, known):
        discard(table)
    return out


def classes_sql(shingle: int, num: int = NUM, den: int = DEN, more: str = "") -> str:
    """The same for keyed documents in DuckDB: all pairs that share a shingle, and what they reach."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < {shingle} THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - {shingle - 2}), lambda i: array_to_string(words[i:i + {shingle - 1}], ' ')) END) AS shingle FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE {den} * shared >= {num} * (a.n + b.n - shared)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id{more} FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(root) AS root FROM r GROUP BY ALL) c ON c.node = d.doc_id
"""
