"""Best-fit packing of tokenized documents into sequences of fixed capacity, after dominance reduction."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, text_chunks
from .tokens import word_tokens

CAPACITY = 2048
END_ID = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, local_rank long"

def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document: its place, length, checksum, and its rank among equal lengths in its task."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = word_tokens(tokenizer_path), np.array([end_id], "<u4").tobytes()
        pid, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for ids, texts in text_chunks(batches):
            rows: list[tuple] = []
            flat, offsets = tokens.encode(texts)
            raw_all, offsets = flat.astype("<u4").tobytes(), (offsets * 4).tolist()
            for doc, a, b in zip(ids, offsets, offsets[1:]):
                raw = raw_all[a:b] + end
                for piece, at in enumerate(range(0, len(raw) // 4, capacity)):
                    own = raw[4 * at : 4 * (at + capacity)]
                    n = len(own) // 4
                    rows.append((doc, piece, at, n, zlib.crc32(own), pid, seen[n]))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in PIECES.split(", ")])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES)


# ---------------------------------------------------------------- packing of a histogram


class _Sizes:
    """A multiset of sizes, sorted, as counts."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def smallest(self, n: int, above: int = 0, but: int = 0) -> list[int]:
        """The n smallest over `above`, one of size `but` left out."""
        out: list[int] = []
        for s in self.sizes[bisect.bisect_right(self.sizes, above) :]:
            out += [s] * min(n - len(out), self.count[s] - (s == but))
            if len(out) >= n:
                break
        return out

    def largest_up_to(self, room: int, but: tuple[int, ...] = ()) -> int:
        """The largest size of at most `room`, or 0; those in `but` are used already."""
        for s in reversed(self.sizes[: bisect.bisect_right(self.sizes, room)]):
            if self.count[s] > but.count(s):
                return s
        return 0

    def best_pair(self, room: int, but: int) -> int:
        """Largest sum of two sizes of at most `room`, or 0."""
        best, lo, hi = 0, 0, bisect.bisect_right(self.sizes, room) - 1
        while lo <= hi:
            a, b = self.sizes[lo], self.sizes[hi]
            need = 2 if a == b else 1
            if self.count[a] - (a == but) < need:
                lo += 1
            elif a != b and self.count[b] - (b == but) < 1:
                hi -= 1
            elif a + b > room:
                hi -= 1
            else:
                best = max(best, a + b)
                lo += 1
        return best


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Martello and Toth's reduction on counts: (sets with how often each is fixed, sizes that remain).

    For a size j, a set of at most three with j is fixed once it provably dominates every other feasible set with j:
    j alone if nothing fits beside it; j with the largest that fits, if that fills the sequence, if no two others fit beside j,
    or if it is at least the sum of any two that fit; j with a and b if those are the largest that fit, no three others fit,
    and of any two that fit one goes in a's place and the other in b's.
    """
    left, fixed, changed = _Sizes(counts), [], True
    while changed:
        changed = False
        for j in sorted(left.sizes, reverse=True):
            while left.count.get(j, 0):
                room = capacity - j
                small = left.smallest(3, but=j)
                fits = sum(sum(small[:n]) <= room for n in range(1, len(small) + 1))
                if fits == 0:
                    done, n = (j,), left.count[j]
                else:
                    a = left.largest_up_to(room, (j,))
                    times = left.count[j] // 2 if a == j else min(left.count[j], left.count[a])
                    if a == room or fits == 1:
                        done, n = (j, a), times if a == room else 1
                    elif fits == 2 and a >= left.best_pair(room, j):
                        done, n = (j, a), 1
                    elif fits == 2 and (b := left.largest_up_to(room - a, (j, a))) and sum(s := left.smallest(2, b, j)) > room and len(s) == 2:
                        done, n = (j, a, b), 1
                    else:
                        break
                n = max(1, n)
                for s in done:
                    left.take(s, n)
                fixed.append((done, n))
                changed = True
    return fixed, left.count


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing on counts: ((size, how many in a sequence), ...) and how many such sequences.

    Equal open sequences are one group, so the work follows the number of sizes, not of pieces.
    """
    open_: dict[int, list[list]] = {}  # room left: groups [content, number]
    rooms: list[int] = []

    def put(room: int, content: tuple, n: int) -> None:
        if n:
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            for g in open_[room]:
                if g[0] == content:
                    g[1] += n
                    return
            open_[room].append([content, n])

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                content, m = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room, content, m = capacity, (), n
            each = room // size  # after one has gone in, the same sequence is the tightest again
            full = min(m, n // each)
            put(room - each * size, (*content, (size, each)), full)
            n -= full * each
            rest = 0
            if full < m and 0 < n < each:
                put(room - n * size, (*content, (size, n)), 1)
                n, rest = 0, 1
            if content:
                put(room, content, m - full - rest)
    return [(content, n) for groups in open_.values() for content, n in groups]


def packed_slots(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Where the pieces of each length go: rows (length, first rank, end rank, first sequence, pieces in a sequence, first offset).

    The piece of that length with rank r is in sequence `first sequence + (r - first rank) // pieces`. There are as many rows at
    most as (size, pattern) pairs: fewer than capacity for each pattern, whatever the number of pieces.
    """
    fixed, rest = reduce_dominated(counts, capacity)
    patterns: dict[tuple, int] = {}
    for sizes, n in fixed:
        content = tuple((s, sizes.count(s)) for s in dict.fromkeys(sizes))
        patterns[content] = patterns.get(content, 0) + n
    for content, n in best_fit(rest, capacity):
        patterns[content] = patterns.get(content, 0) + n
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for content, n in patterns.items():
        offset = 0
        for size, each in content:
            rows.append((size, used[size], used[size] + n * each, sequence, each, offset))
            used[size] += n * each
            offset += size * each
        sequence += n
    assert used == counts
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Packs every document's ids (and an end id) into sequences of at most `capacity` ids.

    Only documents of more than `capacity` ids are cut. Lengths are counted on all pieces; what reaches the driver is one count
    for each of at most `capacity` lengths. There the reduction and best fit run on counts, and each piece finds its place from
    its rank among equal lengths, which needs no gathering: ranks in a task plus counts of the tasks before it.
    A null text counts as empty: a piece with the end id alone. Repeated rows are packed again. An empty table gives no rows.
    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    pieces = materialize(tokenized_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    counts = pieces.groupBy("length", "pid").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    slots = packed_slots({r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = int(slots[:, 2].max()) + 1 if len(slots) else 1
        keys = slots[:, 0] * top + slots[:, 1]
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy()
            at = slots[np.searchsorted(keys, length * top + rank, "right") - 1]
            turn = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(at[:, 3] + turn // at[:, 4]), pa.array(at[:, 5] + turn % at[:, 4] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = pieces.join(firsts, ["length", "pid"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("local_rank") + F.col("first")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
