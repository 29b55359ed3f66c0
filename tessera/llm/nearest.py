"""Approximate nearest neighbours by cosine: stable projections in kd-trees, verified in order until a chi-square test holds.

Unit vectors are projected by Gaussian (2-stable) weights onto few dimensions, where squared distance over the true one is
chi-square distributed. For each query, candidates come in order of projected distance and are measured exactly; the search
stops once a vector nearer than the k-th best so far would by now have been seen with probability CONFIDENCE.

1. A kd-tree's upper splits, fitted on a bounded sample, deal the projected table into regions; the boxes of all vectors of a
   region are exact. Regions of more than BLOCK vectors are dealt into blocks, each with a kd-tree of its own.
2. Every query searches one block of its own region, which gives its k-th best so far.
3. It then goes to the blocks of those regions only whose box the test, with that k-th best, leaves; the search there goes on from it.
   Vectors stay in their blocks (once for every QUERIES queries of a region), queries travel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, settle, small_batches, with_group

K = 5
DIMENSIONS = 16  # projected; even
CONFIDENCE = 0.9
LEAF = 64
SAMPLE = 32_768  # vectors that the upper splits are fitted on at most
REGIONS = 1024  # at most, of each of at most SIZES vector lengths
SIZES = 16
BLOCK = 65_536  # vectors of one tree, about
QUERIES = 65_536  # queries of a region that one task searches for, about
STEP = 1024  # candidates measured between two tests


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi-square of m degrees <= x) = p, for even m."""

    def cdf(x: float) -> float:
        term, total = 1.0, 0.0
        for i in range(m // 2):
            total += term
            term *= x / 2 / (i + 1)
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


class Tree:
    """A kd-tree of points: leaves of at most `leaf` with their boxes, split at the median of the widest side."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.leaves: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            own = todo.pop()
            if len(own) <= leaf:
                self.leaves.append(own)
                continue
            p = points[own]
            side = int((p.max(0) - p.min(0)).argmax())
            half = np.argpartition(p[:, side], len(own) // 2)
            todo += [own[half[: len(own) // 2]], own[half[len(own) // 2 :]]]
        self.low = np.array([points[x].min(0) for x in self.leaves])
        self.high = np.array([points[x].max(0) for x in self.leaves])

    def nearest(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All points in batches, nearest first: (numbers, squared distances); nothing later is nearer than a batch's last."""
        bound = (np.maximum(np.maximum(self.low - q, q - self.high), 0) ** 2).sum(1)
        order = np.argsort(bound, kind="stable")
        kept, far = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 4
        while at < len(order) or len(kept):
            if at < len(order):
                new = np.concatenate([self.leaves[i] for i in order[at : at + step].tolist()])
                kept = np.concatenate([kept, new])
                far = np.concatenate([far, ((self.points[new] - q) ** 2).sum(1)])
                at += step
                step *= 2
            sure = far <= (bound[order[at]] if at < len(order) else np.inf)
            if sure.any():
                own = np.flatnonzero(sure)
                own = own[np.argsort(far[own], kind="stable")]
                yield kept[own], far[own]
                kept, far = kept[~sure], far[~sure]


def projection(size: int) -> np.ndarray:
    return np.random.default_rng(5 + size).standard_normal((size, DIMENSIONS))


class Index:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int = K, confidence: float = CONFIDENCE):
        # a repeated row counts once; of equal vectors, k + 1 of the smallest ids are enough for any query
        by = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[by], vectors[by]
        new = np.append(True, (vectors[1:] != vectors[:-1]).any(1))
        own = new | np.append(True, ids[1:] != ids[:-1])
        ids, vectors, new = ids[own], vectors[own], new[own]
        place = np.arange(len(ids)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        self.ids, self.vectors = ids[place <= k], vectors[place <= k]
        self.k = k
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.unit = self.vectors / self.norms[:, None]
        self.project = projection(vectors.shape[1])
        self.tree = Tree(self.unit @ self.project)
        self.limit = chi_square_quantile(confidence, DIMENSIONS)
        self.measured = 0

    def search(self, query_id: int, vector: np.ndarray, known: float = -2.0) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the k nearest found, nearest first, ties to smaller ids; known: the k-th best cosine found elsewhere."""
        norm = math.sqrt(float(vector @ vector))
        unit = vector / norm
        best, cosines = np.zeros(0, np.int64), np.zeros(0)
        for numbers, far in self.tree.nearest(unit @ self.project):
            for a in range(0, len(numbers), STEP):
                own = numbers[a : a + STEP]
                self.measured += len(own)
                least = max(known, cosines[-1] if len(best) == self.k else -2.0)
                own = own[(self.unit[own] @ unit >= least - 1e-9) & (self.ids[own] != query_id)]  # the exact measure for what may be among the best
                if len(own):
                    cos = (self.vectors[own] * vector).sum(1) / (self.norms[own] * norm)
                    best, cosines = np.concatenate([best, self.ids[own]]), np.concatenate([cosines, cos])
                    order = np.lexsort((best, -cosines))[: self.k]
                    best, cosines = best[order], cosines[order]
                    least = max(known, cosines[-1] if len(best) == self.k else -2.0)
                if least > -2 and far[min(a + STEP, len(far)) - 1] > self.limit * max(2 - 2 * least, 0):
                    return best, cosines
        return best, cosines


class Regions:
    """Upper splits of a kd-tree for each vector length that has them; vectors of other lengths are in region 0."""

    def __init__(self, samples: dict[int, np.ndarray], wanted: int):
        self.splits = {size: self._split(points, wanted) for size, points in samples.items()}

    @staticmethod
    def _split(points: np.ndarray, wanted: int) -> list[tuple[int, float, int, int]]:
        """Nodes (side, cut, node of what is not beyond it, node of the rest); a leaf's side is -1 and its cut its number."""
        nodes, leaves, number = [(-1, 0.0, 0, 0)], [(-len(points), 0, np.arange(len(points)))], 1
        while leaves and number < wanted:
            leaves.sort(key=lambda x: x[:2])
            _, at, own = leaves.pop(0)
            p = points[own]
            side = int((p.max(0) - p.min(0)).argmax()) if len(p) else 0
            cut = float(np.median(p[:, side])) if len(p) else 0.0
            low = p[:, side] <= cut
            if low.all() or not low.any():
                continue
            left, right = len(nodes), len(nodes) + 1
            nodes += [(-1, nodes[at][1], 0, 0), (-1, float(number), 0, 0)]
            nodes[at] = (side, cut, left, right)
            number += 1
            leaves += [(-int(low.sum()), left, own[low]), (-int((~low).sum()), right, own[~low])]
        return nodes

    def of(self, size: int, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))] if size in self.splits else []
        while todo:
            at, own = todo.pop()
            side, cut, left, right = self.splits[size][at]
            if side < 0:
                out[own] = int(cut)
            elif len(own):
                low = points[own, side] <= cut
                todo += [(left, own[low]), (right, own[~low])]
        return out


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, rows, vectors, projections of the unit vectors) for each vector length of a batch with size and v."""
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        v = batch.column("v").take(pa.array(rows)).flatten().to_numpy().reshape(-1, size)
        yield size, rows, v, v / np.sqrt((v * v).sum(1))[:, None] @ projection(size)


def _placed(batches: Iterator[pa.RecordBatch], regions: Regions) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros(batch.num_rows, np.int64)
        for size, rows, _, points in _by_size(batch):
            out[rows] = regions.of(size, points)
        yield pa.RecordBatch.from_arrays([batch.column("size"), pa.array(out), batch.column("vec_id"), batch.column("v")], names=["size", "region", "vec_id", "v"])


EDGES = [f"{x}{i}" for x in "lh" for i in range(DIMENSIONS)]


def _boxes(batches: Iterator[pa.RecordBatch], regions: Regions) -> Iterator[pa.RecordBatch]:
    """(size, region, n, edges): the task's number of vectors in each region and the box of their projections."""
    seen: dict[tuple[int, int], list] = {}
    for batch in batches:
        for size, _, _, points in _by_size(batch):
            own = regions.of(size, points)
            size = size if size in regions.splits else -1
            for region in np.unique(own).tolist():
                p = points[own == region]
                was = seen.setdefault((size, region), [0, np.full(DIMENSIONS, np.inf), np.full(DIMENSIONS, -np.inf)])
                was[0] += len(p)
                was[1], was[2] = np.minimum(was[1], p.min(0)), np.maximum(was[2], p.max(0))
    if seen:
        edges = np.array([np.concatenate(x[1:]) for x in seen.values()])
        cols = [pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.int64()), pa.array([x[0] for x in seen.values()], pa.int64())]
        yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c) for c in edges.T)], names=["size", "region", "n", *EDGES])


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of a block come before the queries that search it; its vectors are held, queries stream."""
    key, held, index = None, [], None
    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in ("size", "region", "block", "part")]
        asked = batch.column("asked").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in (*cols, asked)])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if a == b:
                continue
            own = tuple(int(c[a]) for c in cols)
            if own != key:
                key, held, index = own, [], None
            part = batch.slice(a, b - a)
            ids, vectors = part.column("vec_id").to_numpy(), part.column("v").flatten().to_numpy().reshape(-1, own[0])
            if not asked[a]:
                held.append((ids, vectors))
                continue
            if index is None:
                if not held:
                    continue
                index = Index(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), k)
                held = []
            found = [(q, *index.search(q, v, known)) for q, v, known in zip(ids.tolist(), vectors, part.column("known").to_numpy().tolist())]
            n = [len(x) for _, x, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _, _ in found], n).astype(np.int64)), pa.array(np.concatenate([x for _, x, _ in found])), pa.array(np.concatenate([x for _, _, x in found]))], names=["query_id", "vec_id", "score"])


def _routed(batches: Iterator[pa.RecordBatch], boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], others: int) -> Iterator[pa.RecordBatch]:
    """Queries beside the blocks that the test leaves, but for the one that they have searched."""
    limit = chi_square_quantile(CONFIDENCE, DIMENSIONS)
    for batch in batches:
        row, region, block = [], [], []
        known, home = batch.column("known").to_numpy(), batch.column("region").to_numpy()
        for size, rows, _, points in _by_size(batch):
            if size in boxes:
                numbers, blocks, low, high = boxes[size]
                for r, p in zip(rows.tolist(), points):
                    near = (np.maximum(np.maximum(low - p, p - high), 0) ** 2).sum(1) <= limit * max(2 - 2 * known[r], 0)
                    for j in np.flatnonzero(near).tolist():
                        own = np.arange(1 if numbers[j] == home[r] else 0, blocks[j])
                        row.append(np.full(len(own), r)), region.append(np.full(len(own), numbers[j])), block.append(own)
            else:
                for r in rows.tolist():
                    row.append(np.full(others - 1, r)), region.append(np.zeros(others - 1, np.int64)), block.append(np.arange(1, others))
        if row:
            row, region, block = (np.concatenate(x).astype(np.int64) for x in (row, region, block))
            own = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([own.column("size"), pa.array(region), pa.array(block), own.column("vec_id"), own.column("v"), own.column("known")], names=["size", "region", "block", "vec_id", "v", "known"])


PLACED = "size int, region long, vec_id long, v array<double>"
FOUND = "query_id long, vec_id long, score double"
ROWS = ["size", "region", "block", "part", "asked", "vec_id", "v", "known"]


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query among `vectors` (vec_id, embedding), itself left out.

    Nearness is the largest cosine in doubles; ties go to the smaller vec_id. Vectors that are null, empty, zero or hold nulls or
    non-finite numbers take no part; different lengths don't meet. Every vector is indexed. A repeated row counts once, on
    either side; of several vectors with one vec_id, the least is asked, and the nearest is found. An empty table on either
    side gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)

    def usable(df: DataFrame) -> DataFrame:
        v = df.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        return v.where(finite).where((square > 0) & (square < float("inf"))).withColumn("size", F.size("v"))

    index, asked = usable(vectors), usable(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("size", F.size("v"))
    total = index.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # a bounded sample for the splits only
    sample = index.where(F.pmod(F.xxhash64("vec_id"), F.lit(total)) < SAMPLE).toArrow()
    points: dict[int, np.ndarray] = {}
    for batch in sample.combine_chunks().to_batches():
        for size, _, _, p in _by_size(batch):
            points[size] = np.concatenate([points[size], p]) if size in points else p
    often = sorted(points, key=lambda s: (-len(points[s]), s))[:SIZES]
    regions = Regions({s: points[s] for s in often}, min(REGIONS, max(1, -(-total // BLOCK))))
    edges = [F.min(c).alias(c) for c in EDGES[:DIMENSIONS]] + [F.max(c).alias(c) for c in EDGES[DIMENSIONS:]]
    parts = index.mapInArrow(lambda b: _boxes(b, regions), "size int, region long, n long, " + ", ".join(f"{c} double" for c in EDGES))
    rows = parts.groupBy("size", "region").agg(F.sum("n").alias("n"), *edges).collect()  # at most SIZES * REGIONS + 1
    blocks = {(r["size"], r["region"]): -(-r["n"] // BLOCK) for r in rows}
    others = blocks.pop((-1, 0), 1)
    boxes: dict[int, tuple] = {}
    for size in often:
        own = [r for r in rows if r["size"] == size]
        if own:
            low, high = (np.array([[r[c] for c in part] for r in own]) for part in (EDGES[:DIMENSIONS], EDGES[DIMENSIONS:]))
            boxes[size] = np.array([r["region"] for r in own]), np.array([blocks[size, r["region"]] for r in own]), low, high
    number = spark.createDataFrame([(s, r, n) for (s, r), n in blocks.items()] or [(-2, 0, 1)], "size int, region long, blocks long")

    def placed(df: DataFrame) -> DataFrame:
        return df.select("size", "vec_id", "v").mapInArrow(lambda b: _placed(b, regions), PLACED)

    # as many rows as there are regions, at most SIZES * REGIONS
    dealt = placed(index).join(F.broadcast(number), ["size", "region"], "left").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.coalesce("blocks", F.lit(others))))
    dealt = dealt.select("size", "region", "block", F.lit(False).alias("asked"), "vec_id", "v", F.lit(-2.0).alias("known"))

    def searched(rows: DataFrame) -> DataFrame:
        keys = ["size", "region", "block", "part"]
        return rows.select(ROWS).repartition(*keys).sortWithinPartitions(*keys, "asked").mapInArrow(lambda b: _search(b, k), FOUND)

    part = F.lit(0).cast("long").alias("part")
    first = placed(asked).select("size", "region", F.lit(0).cast("long").alias("block"), F.lit(True).alias("asked"), "vec_id", "v", F.lit(-2.0).alias("known"))
    home = materialize(searched(dealt.where("block = 0").select("*", part).unionByName(first.select("*", part))), "home")
    kth = home.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
    known = placed(asked).join(kth, "vec_id", "left").withColumn("known", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(-2.0)))
    routed = materialize(known.select("size", "region", "vec_id", "v", "known").mapInArrow(lambda b: _routed(b, boxes, others), "size int, region long, block long, vec_id long, v array<double>, known double"), "routed")
    settle(spark)
    loads = routed.groupBy("size", "region", "block").agg(F.ceil(F.count("*") / QUERIES).cast("long").alias("parts"))
    more = with_group(routed, ["size", "region", "block"], "vec_id", [F.ceil(F.count("*") / QUERIES).cast("long").alias("parts")]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).withColumn("asked", F.lit(True))
    beside = dealt.join(loads, ["size", "region", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    found = home.unionAll(searched(beside.select(ROWS).unionByName(more.select(ROWS))))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
