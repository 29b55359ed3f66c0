"""Removal of word passages that an earlier document has, with automata of repeated phrases.

1. Every window of `window` words is shown by an anchor phrase of `phrase` words (winnow). Phrases that anchor windows in two
   documents or more are confirmed: every window that documents share has one.
2. The confirmed phrases are dealt into shards by the smallest document that has them, so that what was copied together stays
   together. A shard's phrases are compiled into an Aho-Corasick automaton. Every document streams through the automata of all
   shards that have one of its anchors: a document whose anchors are all unconfirmed has no repeated window, as each of its
   windows has been looked up, and streams through none. The automaton's hits alone say where phrases occur: windows are
   assigned to the hits in them, and a window without a hit is not repeated.
3. Equal runs are one variant, shown by its smallest document; of different variants on one phrase the windows are compared
   by hash. Windows that a smaller document has are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, discard, grouped_batches, materialize, mix, settle, signed, small_batches, sorted_groups, split_words, text_bytes, text_chunks, whole_groups, window_hashes, with_group, word_hashes
from .winnow import runs, union_spans

WINDOW = 50
PHRASE = 10
PHRASES = 4096  # phrases of a shard, about: some 20 MB of automaton
VARIANTS = 50_000  # variants of a phrase that one task compares at most (41 windows of 8 bytes each); those of more are dealt out by window
PART = 1024  # documents that one part of a shard streams, about
OWN = 0x2545F4914F6CDD1D


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _anchors(batches: Iterator[pa.RecordBatch], window: int, phrase: int) -> Iterator[pa.RecordBatch]:
    """(key, doc_id) of every anchor phrase, once for each document."""
    for ids, texts in text_chunks(batches):
        words, offsets = word_hashes(texts)
        r = runs(words, offsets, window, phrase)
        if len(r.key):
            order = np.lexsort((r.key, r.text))
            key, text = r.key[order], r.text[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(signed(key[new])), pa.array(np.array(ids, np.int64)[text[new]])], names=["key", "doc_id"])


RUNS = "doc_id long, start long, count int, key long, variant long, windows array<long>"


class Phrases:
    """A shard's automaton: words joined by blanks, one before and one after."""

    def __init__(self, phrase: int):
        import ahocorasick

        self.phrase = phrase
        self.automaton = ahocorasick.Automaton()

    def add(self, words: list[bytes]) -> None:
        self.automaton.add_word(_line(words), len(words))

    def compile(self) -> None:
        self.automaton.make_automaton()

    def places(self, words: list[bytes]) -> np.ndarray:
        """The words at which a phrase of the shard starts."""
        if not len(self.automaton):
            return np.zeros(0, np.int64)
        line = _line(words)
        ends = np.fromiter((end for end, _ in self.automaton.iter(line)), np.int64)
        blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32) if len(ends) else ends
        return np.searchsorted(blanks, ends) - self.phrase


def _line(words: list[bytes]) -> str:
    return " " + b" ".join(words).decode("utf-8", "replace") + " "


def _compiled(texts: list[bytes], keys: list[list[int]], window: int, phrase: int) -> Phrases:
    """The automaton of the confirmed phrases that these documents are the first to have."""
    out = Phrases(phrase)
    for text, own in zip(texts, keys):
        words, offsets = word_hashes([text])
        r = runs(words, offsets, window, phrase)
        split = split_words(text)
        for a in r.anchor[np.isin(signed(r.key), np.array(own, np.int64))].tolist():
            out.add(split[a : a + phrase])
    out.compile()
    return out


def _locate(batches: Iterator[pa.RecordBatch], window: int, phrase: int) -> Iterator[pa.RecordBatch]:
    """Runs of the documents of each part of a shard, from the hits of the shard's automaton."""
    for group in grouped_batches(batches, ["shard", "part"]):
        texts = [t or b"" for t in text_bytes(group.column("text"))]
        keys = group.column("keys").to_pylist()
        first = [i for i, own in enumerate(keys) if own]
        automaton = _compiled([texts[i] for i in first], [keys[i] for i in first], window, phrase)
        streamed = np.flatnonzero(group.column("streamed").to_numpy(zero_copy_only=False)).tolist()
        ids = group.column("doc_id").to_pylist()
        at = 0
        while at < len(streamed):
            end, size = at, 0
            while end < len(streamed) and (end == at or size + len(texts[streamed[end]]) <= CHUNK_BYTES):
                size += len(texts[streamed[end]])
                end += 1
            own = streamed[at:end]
            yield from _located([ids[i] for i in own], [texts[i] for i in own], automaton, window, phrase)
            at = end


def _located(ids: list[int], texts: list[bytes], automaton: Phrases, window: int, phrase: int) -> Iterator[pa.RecordBatch]:
    words, offsets = word_hashes(texts)
    hit = np.zeros(len(words), bool)
    for t, a in zip(texts, offsets.tolist()):
        hit[automaton.places(split_words(t)) + a] = True
    if not hit.any():
        return
    r = runs(words, offsets, window, phrase, hit)
    own = window_hashes(words, window, OWN)
    total = mix(own[r.flat] + mix(own[r.flat + r.count - 1] + mix(r.count.astype(np.uint64))))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.array(ids, np.int64)[r.text]), pa.array(r.start), pa.array(r.count.astype(np.int32)), pa.array(signed(r.key)), pa.array(signed(total)), _lists([signed(own[a : a + n]) for a, n in zip(r.flat.tolist(), r.count.tolist())])],
        names=["doc_id", "start", "count", "key", "variant", "windows"],
    )


def _late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each phrase's variants, the windows that one of a smaller document has too."""
    for group in whole_groups(batches, "key"):
        group = group.combine_chunks()
        lists = group.column("windows").chunk(0)
        count = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        key, first, hashes = group.column("key").to_numpy()[row], group.column("first").to_numpy()[row], lists.flatten().to_numpy()
        order = np.lexsort((first, hashes, key))
        new = np.append(True, (key[order][1:] != key[order][:-1]) | (hashes[order][1:] != hashes[order][:-1]))
        least = np.empty(len(row), np.int64)
        least[order] = first[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
        late = least < first
        n = np.bincount(row[late], minlength=len(count))
        some = np.flatnonzero(n)
        places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[some])]).astype(np.int32)), pa.array(place[late].astype(np.int32)))
        yield pa.RecordBatch.from_arrays([*(pa.array(group.column(c).to_numpy()[some]) for c in ("key", "variant")), places], names=["key", "variant", "places"])


def _remove(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        cuts = batch.column("cuts")
        a, b = (cuts.values.field(k).to_numpy(zero_copy_only=False) for k in ("a", "b"))
        ends = cuts.offsets.to_numpy()
        for text, some, x, y in zip(text_bytes(batch.column("text")), cuts.is_valid().to_pylist(), ends.tolist(), ends[1:].tolist()):
            words = split_words(text or b"")
            n, gone = len(words), 0
            kept: list[bytes] = []
            at = 0
            for lo, hi in union_spans(a[x:y], b[x:y]) if some else ():
                kept += words[at:lo]
                gone += hi - lo
                at = hi
            kept += words[at:]
            line = b" ".join(kept)
            out.append((n, gone, hashlib.sha256(line).hexdigest(), line.decode("utf-8", "replace")))
        cols = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def _dealt(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(shard, part, streamed, doc_id, text, keys): documents beside the shards that they stream through, in parts of bounded size.

    A document whose phrases a shard compiles comes to every part of it, with these phrases' keys.
    """
    spark = docs.sparkSession
    anchors = materialize(docs.mapInArrow(lambda b: _anchors(b, window, phrase), "key long, doc_id long"), "anchors")
    bounds = [F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")]
    confirmed = anchors.groupBy("key").agg(*bounds).where("lo < hi").count()
    shards = F.lit(max(1, -(-confirmed // PHRASES)))
    own = with_group(anchors, ["key"], "doc_id", bounds, "lo < hi").withColumn("shard", F.pmod(F.xxhash64("lo"), shards))
    own = own.groupBy("doc_id").agg(F.collect_set("shard").alias("shards"), F.collect_list(F.when(F.col("lo") == F.col("doc_id"), F.col("key"))).alias("keys"))
    routes = materialize(own, "routes")
    discard(anchors)
    settle(spark)
    deals = with_group(routes.select("doc_id", F.explode("shards").alias("shard"), (F.size("keys") > 0).alias("first")), ["shard"], "doc_id", [F.ceil(F.count("*") / PART).alias("parts")])
    mine = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("parts"))
    deals = deals.withColumn("compiled", F.col("first") & (F.col("shard") == F.pmod(F.xxhash64("doc_id"), shards))).withColumn("mine", mine)
    deals = deals.withColumn("part", F.explode(F.when(F.col("compiled"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array("mine"))))
    deals = deals.groupBy("doc_id").agg(F.collect_list(F.struct("shard", "part", (F.col("part") == F.col("mine")).alias("streamed"), "compiled")).alias("deals"))
    deals = materialize(deals.join(routes, "doc_id").select("doc_id", "deals", "keys"), "deals")
    discard(routes)
    settle(spark)
    rows = docs.hint("merge").join(deals, "doc_id").select("doc_id", "text", "keys", F.inline("deals"))
    return rows.select("shard", "part", "streamed", "doc_id", "text", F.when(F.col("compiled"), F.col("keys")).alias("keys"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, a, b): words a to b (exclusive) of a document that windows cover which a document of smaller doc_id has too."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text").where("text is not null and doc_id is not null")
    located = sorted_groups(_dealt(docs, window, phrase), ["shard", "part"]).mapInArrow(lambda b: _locate(b, window, phrase), RUNS)
    located = materialize(located, "runs")
    settle(spark)
    # equal runs are one variant; its smallest document keeps it, as far as variants are concerned
    variants = located.groupBy("key", "variant").agg(F.min("doc_id").alias("first"), F.first("windows").alias("windows"))
    variants = materialize(variants, "variants")
    several = materialize(with_group(variants, ["key"], "variant", [F.count("*").alias("n")], "n > 1"), "several")
    discard(variants)
    settle(spark)
    few = sorted_groups(several.where(F.col("n") <= VARIANTS).select("key", "variant", "first", "windows"), ["key"]).mapInArrow(_late, "key long, variant long, places array<int>")
    # the windows of a phrase of many variants are dealt out one by one
    many = several.where(F.col("n") > VARIANTS).select("key", "variant", "first", F.posexplode("windows").alias("place", "hash"))
    many = with_group(many, ["key", "hash"], "variant", [F.min("first").alias("least")]).where("least < first").groupBy("key", "variant").agg(F.collect_list("place").alias("places"))
    late = materialize(few.unionAll(many), "late")
    settle(spark)
    found = with_group(located.select("doc_id", "start", "count", "key", "variant"), ["key", "variant"], "doc_id", [F.min("doc_id").alias("first")])
    whole = found.where("doc_id > first").select("doc_id", F.col("start").alias("a"), (F.col("start") + F.col("count") - 1 + window).alias("b"))
    part = found.where("doc_id = first").join(late, ["key", "variant"]).select("doc_id", "start", F.explode("places").alias("place")).withColumn("a", F.col("start") + F.col("place"))
    spans = materialize(whole.unionAll(part.select("doc_id", "a", (F.col("a") + window).alias("b"))), "spans")
    for table in (located, several, late):
        discard(table)
    settle(spark)
    return spans


def dedup_substrings(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. Each word is removed that a window of `window` words covers whose word sequence also
    starts in a document with a smaller doc_id; windows are judged on the input. Null text: no words. doc_id is a key (rows
    that repeat one are one document to the search, and each is cut; of null ones nothing is removed, and nothing because of them).
    Shorter documents keep all. Extra columns are not read; an empty table gives no rows.
    """
    spans = repeated_spans(docs, window, phrase)
    cuts = spans.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("cuts"))
    rows = docs.select("doc_id", "text").hint("merge").join(cuts, "doc_id", "left")
    return rows.mapInArrow(lambda b: _remove(b, window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


# the same for keyed documents in DuckDB: every window by itself
SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
k AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS first FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM k WHERE first < doc_id),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id),
e AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM e ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
