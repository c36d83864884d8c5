"""Problem 3: the most similar vectors, by stable projections in kd-trees with a chi-square stopping test.

A vector times a matrix of standard normal numbers is a point in few dimensions, and the squared distance of two such
points over that of the two vectors is chi-square distributed. So one walks a tree of the points outwards from the query's
point, compares the real vectors, and stops when everything left is so far out that a vector nearer than the k-th best so
far would have been an unlikely one: at a squared distance above ``quantile(SURE)`` times the k-th best's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import cut, spread

#: Dimensions of the projection (even), and how sure the stopping test must be of each neighbour. Most are surer than the
#: last one, and cells are nearer than their points: recall is above 0.99 (measured in the tests, and against all vectors by p3_recall).
DIMS, SURE = 6, 0.95
#: Vectors in a cell of the upper tree and in a block of neighbouring cells, points in a leaf of a block's own tree.
CELL, BLOCK, LEAF = 128, 8192, 48
#: Vectors of the bounded sample that places the upper tree's splits, most cells of it, cells of the first round, queries that
#: meet a block at once.
SAMPLE, MAX_CELLS, FIRST_CELLS, QUERIES = 50_000, 65_536, 48, 2048
#: Squared distances of points that are equal but for rounding.
SLACK = 1e-9


def quantile(p: float, dims: int = DIMS) -> float:
    """Of the chi-square distribution with an even number of degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        term, left = 1.0, 0.0
        for i in range(dims // 2):
            left += term
            term *= x / 2 / (i + 1)
        low, high = (x, high) if 1 - math.exp(-x / 2) * left < p else (low, x)
    return low


def _matrix(width: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((width, DIMS))


class _Upper:
    """A tree that halves a sample of points ``depth`` times, each time along the widest side: its splits level by level, and
    the boxes (cell, 2, DIMS) of its cells in order, so that neighbouring cells have neighbouring numbers."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, self.axis, self.at = depth, np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        boxes, groups = np.stack([np.full(DIMS, -np.inf), np.full(DIMS, np.inf)])[None], [points]
        for level in range(depth):
            boxes, halves = np.repeat(boxes, 2, axis=0), []
            for n, own in enumerate(groups):
                axis = int(np.argmax(own.std(axis=0))) if len(own) else 0
                at = float(np.median(own[:, axis])) if len(own) else 0.0
                self.axis[(1 << level) + n], self.at[(1 << level) + n] = axis, at
                boxes[2 * n, 1, axis], boxes[2 * n + 1, 0, axis] = min(boxes[2 * n, 1, axis], at), max(boxes[2 * n + 1, 0, axis], at)
                halves += [own[own[:, axis] < at], own[own[:, axis] >= at]]
            groups = halves
        self.boxes = boxes

    def cells(self, points: np.ndarray) -> np.ndarray:
        node, rows = np.ones(len(points), np.int64), np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + (points[rows, self.axis[node]] >= self.at[node])
        return node - (1 << self.depth)


def _to_boxes(points: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Squared distances (point, box)."""
    out = np.zeros((len(points), len(boxes)))
    for d in range(points.shape[1]):
        x = points[:, d, None]
        gap = np.maximum(boxes[None, :, 0, d] - x, x - boxes[None, :, 1, d])
        out += np.square(np.maximum(gap, 0))
    return out


class _Tree:
    """A kd-tree of the points of one block: leaves of about ``LEAF`` points with their boxes."""

    def __init__(self, points: np.ndarray):
        groups = [np.arange(len(points))]
        while len(groups[0]) > LEAF:
            halves = []
            for g in groups:
                own = points[g]
                axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                order = np.argpartition(own[:, axis], len(g) // 2)
                halves += [g[order[: len(g) // 2]], g[order[len(g) // 2 :]]]
            groups = halves
        self.groups = groups
        self.boxes = np.stack([np.stack([points[g].min(axis=0), points[g].max(axis=0)]) for g in groups])


class _Block:
    """The vectors of one block with their tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        _, first = np.unique(ids, return_index=True)  # rows repeated under one id count once
        self.ids, self.vectors = ids[first], _unit(vectors[first])
        self.matrix = _matrix(vectors.shape[1])
        self.tree = _Tree(self.vectors @ self.matrix)
        self.met = 0  # leaves that queries met

    def search(self, queries: np.ndarray, own: np.ndarray, reach: np.ndarray, k: int, above: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the query, id and squared distance of the up to ``k`` best of the block for each query.

        ``reach``: the squared distance of the k-th best known from elsewhere; infinite where there is none. Only leaves whose
        squared distance lies above ``above`` and up to ``upto`` are met. A query's leaves are met nearest first, twice as
        many with each turn, until the stopping test holds; queries that meet the same leaf in a turn are compared with it by
        one product.
        """
        limit, queries = quantile(SURE), _unit(queries)
        away = _to_boxes(queries @ self.matrix, self.tree.boxes)
        away[(away <= above[:, None]) | (away > upto[:, None])] = np.inf
        order = np.argsort(away, axis=1, kind="stable")
        best = np.full((len(queries), k), np.inf)
        best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        at, step, leaves = 0, 2, away.shape[1]
        while at < leaves:
            stop = min(at + step, leaves)
            kth = np.minimum(reach, best[:, -1])
            turn = order[:, at:stop]
            far = np.take_along_axis(away, turn, axis=1)
            q, column = np.nonzero((far <= (kth * limit + SLACK)[:, None]) & (far < np.inf))
            if not len(q):
                break
            self.met += len(q)
            leaf = turn[q, column]
            by_leaf = np.argsort(leaf, kind="stable")
            q, leaf = q[by_leaf], leaf[by_leaf]
            edges = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1], True])
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                rows, members = q[low:high], self.tree.groups[leaf[low]]
                far = np.maximum(0.0, 2 - 2 * (queries[rows] @ self.vectors[members].T))
                far[own[rows][:, None] == self.ids[members][None, :]] = np.inf
                better = np.flatnonzero(far.min(axis=1) <= best[rows, -1])
                rows, far = rows[better], np.concatenate([best[rows[better]], far[better]], axis=1)
                named = np.concatenate([best_ids[rows], np.broadcast_to(self.ids[members], (len(rows), len(members)))], axis=1)
                keep = np.lexsort((named, far), axis=-1)[:, :k]
                best[rows], best_ids[rows] = np.take_along_axis(far, keep, axis=1), np.take_along_axis(named, keep, axis=1)
            at, step = stop, step * 2
        q, place = np.nonzero(best < np.inf)
        return q, best_ids[q, place], best[q, place]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Packed vectors as they came, in single precision."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)


def _prepared(df: DataFrame, key: str, width: int, upper=None, cells: int = 1) -> DataFrame:
    """``id, vector`` (packed) and ``block`` of the usable rows of ``df``; ``upper``: a broadcast tree, ``cells``: of it in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = _matrix(width)
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), dtype=np.float32).reshape(-1, width)
            norm = np.linalg.norm(x.astype(np.float64), axis=1)
            fine = np.isfinite(norm) & (norm > 0)
            x = x[fine]
            block = upper.value.cells(_unit(x) @ matrix) // cells if upper is not None else np.zeros(len(x), int)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * width), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fine)), packed, pa.array(block, pa.int32())], ["id", "vector", "block"])

    usable = F.col(key).isNotNull() & (F.size("embedding") == width) & F.forall("embedding", lambda x: x.isNotNull())
    return df.where(usable).select(F.col(key).cast("long").alias("id"), "embedding").mapInArrow(run, "id long, vector binary, block int")


def nearest(vectors: DataFrame, queries: DataFrame, key: str = "chunk_id", k: int = 10, width: int = 64, met=None) -> DataFrame:
    """For each id of ``queries`` (column ``key``) its ``k`` most similar other rows of ``vectors`` by cosine.

    ``id, neighbour, similarity, rank``. Rows whose id is null or whose embedding is null, all zero, not finite, holds nulls
    or is not ``width`` long take no part; rows repeated under one id count once; of equally similar rows the lower id comes
    first; with fewer than ``k`` other rows there are fewer. Vectors count in single precision.

    A bounded sample of ``SAMPLE`` vectors places the splits of an upper tree with cells of about ``CELL`` vectors and at most
    ``MAX_CELLS`` of them; all vectors are in its cells, and neighbouring cells of about ``BLOCK`` vectors are a block; one with
    more - also of equal vectors - is several. First each query meets what is as near as its ``FIRST_CELLS`` nearest cells,
    then, with the k-th distance found, all else that the stopping test leaves; nothing is met twice. Vectors go to their
    block once a round; queries come to a block in batches behind its vectors, any number of them. ``met``: two
    accumulators, of leaves that queries met and of all leaves of the collection for each query.
    """
    spark, limit = vectors.sparkSession, quantile(SURE)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = (_unit(_rows(batch.column(0), width)) @ _matrix(width)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([points.tobytes()], pa.binary())], ["point"])

    rows = vectors.count()
    depth = min(int(math.log2(MAX_CELLS)), max(0, math.ceil(math.log2(max(1, rows) / CELL))))
    cells = 1 << min(depth, max(0, round(math.log2(BLOCK / max(1, rows / (1 << depth))))))  # of a block
    every = max(1, rows // SAMPLE)
    sample = np.empty((0, DIMS))
    if depth:
        some = _prepared(vectors.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0), key, width).select("vector").limit(2 * SAMPLE)
        points = some.mapInArrow(projected, "point binary").toPandas()["point"]  # a few numbers of each
        sample = np.frombuffer(b"".join(points), np.float32).reshape(-1, DIMS).astype(np.float64)
    upper = spark.sparkContext.broadcast(_Upper(sample, depth))
    ready = cut(_prepared(spread(vectors), key, width, upper, cells))
    counts = {r["block"]: r["n"] for r in ready.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MAX_CELLS rows
    parts = spark.createDataFrame([(c, max(1, math.ceil(n / BLOCK))) for c, n in counts.items()], "block int, parts int")
    blocks = sum(max(1, math.ceil(n / BLOCK)) for n in counts.values())
    tasks = max(2 * spark.sparkContext.defaultParallelism, min(blocks, 20_000))
    asked = queries.select(F.col(key).cast("long").alias("id")).distinct()
    ready_queries = cut(ready.join(asked, "id", "left_semi").dropDuplicates(["id"]).select("id", "vector"))
    nothing = [F.lit(0.0).alias(c) for c in ("reach", "above", "upto")]
    placed = ready.join(F.broadcast(parts), "block").select("block", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(0).alias("asks"), "id", "vector", *nothing)

    def routes(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        """Each query (``id, vector, reach``) with the blocks it goes to, and between which distances it meets leaves there."""
        matrix, boxes = _matrix(width), upper.value.boxes
        step = max(1, (1 << 22) // len(boxes))
        for batch in batches:
            x, known = _rows(batch.column(1), width), batch.column(2).to_numpy(zero_copy_only=False)
            for start in range(0, len(x), step):
                away = _to_boxes(_unit(x[start : start + step]) @ matrix, boxes)
                nearest_cells = np.partition(away, min(FIRST_CELLS, len(boxes)) - 1, axis=1)[:, min(FIRST_CELLS, len(boxes)) - 1]
                blockwise = away.reshape(len(away), -1, cells).min(axis=2)
                reach = known[start : start + step]
                above = np.full(len(away), -1.0) if first else nearest_cells
                upto = nearest_cells if first else reach * limit + SLACK
                q, block = np.nonzero(blockwise <= upto[:, None])
                for at in range(0, len(q), 8192):
                    own = q[at : at + 8192]
                    taken = batch.slice(start, step).take(pa.array(own))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(above[own]), pa.array(upto[own]), pa.array(block[at : at + 8192], pa.int32())], ["id", "vector", "reach", "above", "upto", "block"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams blocks, each as its vectors and then its queries."""
        now, held, block = None, [], None
        for batch in batches:
            own, part, asks = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1]), True]) if len(batch) else []
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                some, place = batch.slice(low, high - low), (own[low], part[low])
                if place != now:
                    if met is not None and block is not None:
                        met[0].add(block.met)
                    now, held, block = place, [], None
                if not asks[low]:
                    held.append((some.column(3).to_numpy(), _rows(some.column(4), width)))
                    continue
                if block is None and held:
                    block, held = _Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])), []
                for at in range(0, len(some) if block else 0, QUERIES):
                    turn = some.slice(at, QUERIES)
                    ids = turn.column(3).to_numpy()
                    q, found, far = block.search(_rows(turn.column(4), width), ids, turn.column(5).to_numpy(), k, turn.column(6).to_numpy(), turn.column(7).to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(found), pa.array(far)], ["id", "neighbour", "far"])
        if met is not None and block is not None:
            met[0].add(block.met)

    def turn(asked: DataFrame, first: bool) -> DataFrame:
        sent = asked.mapInArrow(partial(routes, first=first), "id long, vector binary, reach double, above double, upto double, block int").join(F.broadcast(parts), "block")
        sent = sent.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("asks"), "id", "vector", "reach", "above", "upto")
        return placed.unionByName(sent).repartition(tasks, "block", "part").sortWithinPartitions("block", "part", "asks").mapInArrow(meet, "id long, neighbour long, far double")

    best = Window.partitionBy("id").orderBy("far", "neighbour")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    one = cut(ranked(turn(ready_queries.withColumn("reach", F.lit(math.inf)), True)))
    reach = one.where(F.col("rank") == k).select("id", F.col("far").alias("reach"))
    two = turn(ready_queries.join(reach, "id", "left").select("id", "vector", F.coalesce("reach", F.lit(math.inf)).alias("reach")), False)
    if met is not None:
        met[1].add(ready_queries.count() * sum(max(1, math.ceil(n / LEAF)) for n in counts.values()))
    return ranked(one.drop("rank").unionByName(two)).select("id", "neighbour", (1 - F.col("far") / 2).alias("similarity"), "rank")
