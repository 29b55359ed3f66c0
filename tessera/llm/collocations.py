"""Phrase collocations by pivot partitioning: frequent contiguous phrases are mined where their rarest word is.

1. Words are counted. A table of fixed size (BUCKETS hash buckets) says which words can be frequent and which are rarer.
2. Each occurrence of a word is the pivot of one fragment: the words beside it that aren't rarer, on the left only more common
   ones, within the longest phrase's reach. Infrequent words and piece ends cut it. Every occurrence of a phrase lies around the
   first occurrence of its rarest word in it, in one fragment, and is counted there.
3. Fragments travel to shards by pivot, equal ones of a block of text as one with its count. A pivot of more than FRAGMENTS
   occurrences is dealt over several shards, whose counts are added up. A shard counts its pivots' phrases by hash and
   passes on those that are frequent (of pivots in several shards: all).
4. Scores come from joins of each phrase's cuts with the counts of both parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import grouped_batches, materialize, mix, settle, signed, small_batches, text_bytes, window_hashes, with_group

LEAST = 100  # occurrences of a phrase
LONGEST = 5
TOP = 2000
BUCKETS = 22  # bits of a word's hash: the table has 2^22 places at any size
FRAGMENTS = 500_000  # fragments of a shard, about
CHUNK = 4 << 20  # text of one language that is taken apart at once
BASE = 0xC2B2AE3D27D4EB4F
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENDS = ".,;:!?\n\x0b\x0c\r"  # of pieces
PIECES = bytes.maketrans((UPPER + ENDS).encode(), (LOWER + "\n" * len(ENDS)).encode())
ROWS = "shard long, lang string, words binary, n_words int, at binary, shape binary, n binary"


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of all words; null lang is 'und'."""
    words = F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), r"[\x20\x09.,;:!?\x0A-\x0D]+")
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(words).alias("word"))
    return rows.where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("f"))


def word_keys(words: list[bytes], lang: str) -> np.ndarray:
    """A 64-bit key of each word of a language."""
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return mix(own + np.uint64(xxhash.xxh3_64_intdigest(lang.encode())))


def _buckets(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs, words = b.column("lang").to_pylist(), text_bytes(b.column("word"))
        keys = np.array([word_keys([w], lang)[0] for w, lang in zip(words, langs)], np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(64 - bits)).astype(np.int64)), b.column("f")], names=["bucket", "f"])


def rarity(frequent: DataFrame, bits: int, per_shard: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each bucket, -1: no frequent word; shards of each rank). Ranks go from the most common bucket to the rarest.

    There are 2^bits buckets however many words there are. Words that share one share its rank; their keys order them.
    """
    found = frequent.mapInArrow(partial(_buckets, bits=bits), "bucket long, f long").groupBy("bucket").agg(F.sum("f").alias("f")).toArrow()
    bucket, f = found.column("bucket").to_numpy(), found.column("f").to_numpy()
    order = np.lexsort((bucket, -f))
    rank = np.full(1 << bits, -1, np.int32)
    rank[bucket[order]] = np.arange(len(bucket))
    return rank, np.ceil(f[order] / per_shard).astype(np.int64)


def _occurrences(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words and the number of each one's piece."""
    data = b"\n".join(texts).translate(PIECES)
    chars = np.frombuffer(data, np.uint8)
    blank = (chars == 0x20) | (chars == 0x09) | (chars == 0x0A)
    first = ~blank
    first[1:] &= blank[:-1]
    return data.split(), np.cumsum(chars == 0x0A)[np.flatnonzero(first)]


def fragments(order: np.ndarray, piece: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pivot's place, words left of it, words right of it) of each occurrence that has a neighbour; order: 0 infrequent, greater is rarer."""
    n = len(order)
    sides = []
    for left in (True, False):
        reached, grown = order > 0, np.zeros(n, np.int8)
        for d in range(1, min(reach, n - 1) + 1):
            here, there = (slice(d, None), slice(None, -d)) if left else (slice(None, -d), slice(d, None))
            near = np.zeros(n, bool)
            near[here] = (piece[here] == piece[there]) & (order[there] > 0) & (order[there] < order[here] if left else order[there] <= order[here])
            reached &= near
            grown += reached
        sides.append(grown)
    pivot = np.flatnonzero((sides[0] + sides[1] > 0) & (order > 0))
    return pivot, sides[0][pivot].astype(np.int64), sides[1][pivot].astype(np.int64)


def _stretch(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in it) of the elements of rows of these sizes, in turn."""
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary value for each row: the bytes of its share of the values."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _fragment_rows(lang: str, texts: list[bytes], rank: np.ndarray, parts: np.ndarray, shards: int) -> pa.RecordBatch | None:
    """One row for each shard: its fragments in a dictionary of their words."""
    words, piece = _occurrences(texts)
    keys = word_keys(words, lang)
    own = rank[(keys >> np.uint64(64 - (len(rank) - 1).bit_length())).astype(np.int64)].astype(np.int64)
    order = np.where(own < 0, 0, (own + 1) << 40 | (keys & np.uint64((1 << 40) - 1)).astype(np.int64))
    pivot, left, right = fragments(order, piece, LONGEST - 1)
    if not len(pivot):
        return None
    # equal fragments as one
    content = left.astype(np.uint64)
    for d in range(-LONGEST + 1, LONGEST):
        inside = (-left <= d) & (d <= right)
        content = mix(content + np.where(inside, keys[np.minimum(np.maximum(pivot + d, 0), len(keys) - 1)], np.uint64(1)))
    content, pick, n = np.unique(content, return_index=True, return_counts=True)
    pivot, left, right = pivot[pick], left[pick], right[pick]
    split = parts[own[pivot]]
    part = (content >> np.uint64(1)).astype(np.int64) % split
    shard = (mix(order[pivot].astype(np.uint64) + np.uint64(BASE) * part.astype(np.uint64)) >> np.uint64(1)).astype(np.int64) % shards
    by = np.argsort(shard, kind="stable")
    pivot, left, right, n, split, shard = pivot[by], left[by], right[by], n[by], split[by], shard[by]
    heads = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    row = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(shard))))
    size = left + right + 1
    of, place = _stretch(size)
    token = (pivot - left)[of] + place
    distinct, first, word = np.unique(keys[token], return_index=True, return_inverse=True)
    code, at = np.unique(row[of] * len(distinct) + word, return_inverse=True)
    dict_row = code // len(distinct)
    n_words = np.bincount(dict_row, minlength=len(heads))
    starts = np.concatenate([[0], np.cumsum(n_words)])
    at = (at - starts[row[of]]).astype(np.uint32)
    texts_of = pa.array([words[i] for i in token[first].tolist()], pa.binary()).take(pa.array(code % len(distinct)))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), texts_of), pa.scalar(b" ", pa.binary()))
    in_row = np.bincount(row, minlength=len(heads))
    shape = (left | right << 3 | (split == 1).astype(np.int64) << 6).astype(np.uint8)
    columns = [pa.array(shard[heads]), pa.array([lang] * len(heads), pa.string()), joined, pa.array(n_words.astype(np.int32)), _binary(at, np.bincount(row, size, len(heads)).astype(np.int64)), _binary(shape, in_row), _binary(n.astype(np.uint32), in_row)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ROWS.split(", ")])


def _route(batches: Iterator[pa.RecordBatch], table: Broadcast, shards: int) -> Iterator[pa.RecordBatch]:
    rank, parts = table.value
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), text_bytes(b.column("text"))):
            if text:
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= CHUNK or sum(size.values()) >= 4 * CHUNK:
                    full = max(size, key=size.get)
                    out = _fragment_rows(full, held.pop(full), rank, parts, shards)
                    del size[full]
                    if out is not None:
                        yield out
    for lang, texts in held.items():
        out = _fragment_rows(lang, texts, rank, parts, shards)
        if out is not None:
            yield out


def _mine(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The phrases that pivots of each shard own, with their occurrences there."""
    for group in grouped_batches(batches, ["shard", "lang"]):
        words = [w for row in group.column("words").to_pylist() for w in row.split(b" ")]
        keys = word_keys(words, "")
        at, shape, n = (np.frombuffer(b"".join(group.column(c).to_pylist()), t).astype(np.int64) for c, t in (("at", np.uint32), ("shape", np.uint8), ("n", np.uint32)))
        n_words = group.column("n_words").to_numpy()
        in_row = np.array([len(x) // 4 for x in group.column("at").to_pylist()])
        at += np.repeat(np.cumsum(n_words) - n_words, in_row)
        left, right, whole = shape & 7, shape >> 3 & 7, shape >> 6 == 1
        size = left + right + 1
        pivot = np.cumsum(size) - size + left
        flat = keys[at]
        phrases, counts = [], []
        for length in range(2, LONGEST + 1):
            own = [(np.flatnonzero((left >= x) & (right >= length - 1 - x)), x) for x in range(length)]
            fragment = np.concatenate([i for i, _ in own])
            if not len(fragment):
                continue
            start = np.concatenate([pivot[i] - x for i, x in own])
            _, pick, same = np.unique(window_hashes(flat, length, BASE)[start], return_index=True, return_inverse=True)
            total = np.bincount(same, n[fragment]).astype(np.int64)
            for i in np.flatnonzero((total >= least) | ~whole[fragment[pick]]).tolist():
                s = start[pick[i]]
                phrases.append(b" ".join([words[j] for j in at[s : s + length].tolist()]))
                counts.append((length, total[i]))
        if phrases:
            lang = pa.array([group.column("lang")[0].as_py()] * len(phrases), pa.string())
            yield pa.RecordBatch.from_arrays([lang, pa.array(phrases, pa.binary()).cast(pa.string()), *(pa.array(c, pa.int64()) for c in zip(*counts))], names=["lang", "phrase", "length", "f"])


def frequent_phrases(docs: DataFrame, words: DataFrame, least: int = LEAST, bits: int = BUCKETS, per_shard: int = FRAGMENTS) -> DataFrame:
    """(lang, phrase, length, f) of all phrases of 2 to 5 words that occur `least` times; words: (lang, word, f) of those that do."""
    spark = docs.sparkSession
    small_batches(spark)
    rank, parts = rarity(words, bits, per_shard)
    total = words.agg(F.sum("f")).first()[0] or 0
    shards = -(-total // per_shard) or 1
    table = spark.sparkContext.broadcast((rank, parts))
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    rows = texts.mapInArrow(partial(_route, table=table, shards=shards), ROWS)
    rows = rows.repartition("shard", "lang").sortWithinPartitions("shard", "lang")
    found = rows.mapInArrow(partial(_mine, least=least), "lang string, phrase string, length long, f long")
    return found.groupBy("lang", "phrase", "length").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, bits: int = BUCKETS, per_shard: int = FRAGMENTS) -> DataFrame:
    """Each language's `top` phrases: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts are lower-cased in ASCII and split into pieces at .,;:!? and line ends, pieces into words at blanks and tabs. a counts a
    phrase of 2 to 5 words, overlaps included; n counts the language's words. A cut of the phrase has counts l and r of its
    parts and scores floor(1000 a n / (l r)); the lowest cut counts, of equal ones the earliest. A phrase inside a longer one
    that occurs as often goes. Order: score, a, phrase in UTF-8. Each row is a document; doc_id is not read. Null text is
    empty, null lang 'und'. Extra columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    words = materialize(word_counts(docs), "words")
    langs = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = words.where(F.col("f") >= least)
    grams = materialize(frequent_phrases(docs, words, least, bits, per_shard), "phrases")
    settle(spark)
    known = words.select("lang", F.col("word").alias("part"), "f").unionByName(grams.select("lang", F.col("phrase").alias("part"), "f"))
    sized = with_group(grams.withColumnRenamed("f", "a"), ["lang"], "phrase", [], also=lambda groups: groups.join(langs, "lang"))
    cuts = sized.withColumn("k", F.explode(F.expr("sequence(1L, length - 1)")))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', cast(k as int))"), "rest": F.expr("substring_index(phrase, ' ', cast(k - length as int))")})
    for part, count in (("first", "l"), ("rest", "r")):
        facts = known.select("lang", F.col("part").alias(part), F.col("f").alias(count))
        cuts = with_group(cuts, ["lang", part], "phrase", [], also=lambda groups, facts=facts, part=part: groups.join(facts, ["lang", part]))
    exact = {c: F.col(c).cast("decimal(19,0)") for c in "anlr"}
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (exact["a"] * exact["n"]), exact["l"] * exact["r"])
    scored = cuts.select("lang", "phrase", F.struct(score.alias("score"), "k", "l", "r", "a", "n").alias("cut"), F.lit(None).cast("long").alias("longer"))
    # counts only fall with length: what a longer phrase equals, the one of a word more equals
    shorter = grams.where("length > 2").select("lang", F.explode(F.expr("array(substring_index(phrase, ' ', cast(length - 1 as int)), substring_index(phrase, ' ', cast(1 - length as int)))")).alias("phrase"), F.lit(None).alias("cut"), F.col("f").alias("longer"))
    best = scored.unionByName(shorter).groupBy("lang", "phrase").agg(F.min("cut").alias("cut"), F.max("longer").alias("longer"))
    best = best.where("longer is null or 100 * longer < 100 * cut.a").select("lang", "phrase", "cut.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = rf"""
WITH p AS (SELECT lang, row_number() OVER () AS id, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
o AS (SELECT lang, m, w[i:i + m - 1] AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, range(1, {LONGEST + 1}) AS t(m) WHERE len(w) >= m)),
n AS (SELECT lang, count(*) AS n FROM o WHERE m = 1 GROUP BY ALL),
f AS (SELECT lang, m, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*) AS f FROM o GROUP BY lang, m, phrase HAVING count(*) >= {LEAST}),
c AS (SELECT lang, m, phrase, g, f AS a FROM f WHERE m > 1),
k AS (SELECT c.*, k, array_to_string(g[1:k], ' ') AS one, array_to_string(g[k + 1:m], ' ') AS two FROM c, range(1, {LONGEST}) AS t(k) WHERE k < m),
s AS (SELECT k.lang, k.m, k.phrase, k.a, k, x.f AS l, y.f AS r, n.n, 1000 * k.a::HUGEINT * n.n // (x.f::HUGEINT * y.f) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.one JOIN f y ON y.lang = k.lang AND y.phrase = k.two JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT lang, a, array_to_string(g[i:i + j - 1], ' ') AS phrase FROM (SELECT c.*, j, unnest(range(1, m - j + 2)) AS i FROM c, range(2, {LONGEST}) AS t(j) WHERE j < m)),
inside AS (SELECT DISTINCT lang, phrase FROM sub JOIN c USING (lang, phrase) WHERE 100 * sub.a >= 100 * c.a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (
  SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN inside USING (lang, phrase)) WHERE rank <= {TOP}
"""
