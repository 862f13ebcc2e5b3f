"""Vantage-point partitioning: a small tree of pivots routes points to leaves, and searches read few leaves.

The tree is built on a bounded sample (it only decides how balanced leaves are, never what is found), is broadcast,
and every point is routed through it once; points are stored in order of leaf. A search has two passes: the home
leaf gives a radius for each query, and the leaves that the radius reaches are read. Which leaf is read for which
query is a bit table that is broadcast; row groups of other leaves are skipped by their statistics, and distances are
computed in blocks where the points are, so that nothing but the best k of each task is shuffled. In a metric space
with alpha = exp = 1 the answer is exact.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distances import distance
from ..functions.kernels import block, kernel
from ..shipping import ship
from ..storage import stored
from .knn import FOUND_SCHEMA, FOUND, Best, collected, columns, payloads, query_blocks, top_k

#: Points that the tree is built on, at most: it has about SAMPLE / 2 leaves then, whatever the table's size.
SAMPLE = 1 << 15
BUCKET = 50
#: Queries of a block, and leaves that a filter lists, at most.
QUERIES = 4096
MOST_LISTED = 4096
ATTEMPTS = 5


@dataclass
class Node:
    pivot: np.ndarray  # one row
    median: float
    left: Node | int
    right: Node | int


@dataclass
class Pruner:
    """Left is skipped when a query lies right of the median by more than the radius allows, and the reverse."""

    alpha_left: float = 1.0
    alpha_right: float = 1.0
    exp_left: float = 1.0
    exp_right: float = 1.0

    def sides(self, d: float, median: float, radius: float) -> tuple[bool, bool]:
        gap = abs(median - d)
        if d < median:
            return True, not radius < self.alpha_left * gap**self.exp_left
        return not radius < self.alpha_right * gap**self.exp_right, True


@dataclass
class Tree:
    root: Node | int
    leaves: int
    dist: str
    params: dict

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int32)

        def go(node: Node | int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if isinstance(node, int):
                out[rows] = node
                return
            d = kernel(self.dist, x[rows], node.pivot, **self.params)[:, 0]
            go(node.left, rows[d < node.median])
            go(node.right, rows[d >= node.median])

        go(self.root, np.arange(len(x)))
        return out

    def reached(self, q, radius: float, pruner: Pruner, most: int | None = None) -> list[int]:
        """Leaves that may hold points within the radius, the near side of each node first."""
        out: list[int] = []
        stack = [self.root]
        while stack and (most is None or len(out) < most):
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
                continue
            d = float(kernel(self.dist, node.pivot, q, **self.params)[0, 0])
            left, right = pruner.sides(d, node.median, radius)
            both = [node.right] * right + [node.left] * left if d < node.median else [node.left] * left + [node.right] * right
            stack += both
        return out

    def reach(self, q, radius: np.ndarray, pruner: Pruner, most: int | None = None) -> np.ndarray:
        """The same for a block of queries: a table of leaves and queries."""
        out = np.zeros((self.leaves, len(q)), bool)
        if most is not None:
            for i in range(len(q)):
                out[self.reached(q[i : i + 1], float(radius[i]), pruner, most), i] = True
            return out

        def go(node: Node | int, at: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(node, int):
                out[node, at] = True
                return
            d = kernel(self.dist, node.pivot, q[at], **self.params)[0]
            gap, near = np.abs(node.median - d), d < node.median
            left = near | ~(radius[at] < pruner.alpha_right * gap**pruner.exp_right)
            right = ~near | ~(radius[at] < pruner.alpha_left * gap**pruner.exp_left)
            go(node.left, at[left])
            go(node.right, at[right])

        go(self.root, np.arange(len(q)))
        return out

    def rows(self) -> list[tuple[int, float, int, int, list]]:
        """The nodes as rows: number, median, left, right (a leaf is -1 - its number), pivot."""
        out: list = []

        def add(node: Node | int) -> int:
            if isinstance(node, int):
                return -1 - node
            i = len(out)
            out.append(None)
            out[i] = (i, node.median, add(node.left), add(node.right), node.pivot)
            return i

        add(self.root)
        return out


def build_tree(sample, dist: str, bucket: int, seed: int = 0, attempts: int = ATTEMPTS, **params) -> Tree:
    """Splits at the median distance from the pivot, of a few tried, whose distances spread most."""
    random, counter = np.random.default_rng(seed), itertools.count()

    def make(rows: np.ndarray) -> Node | int:
        if len(rows) <= bucket:
            return next(counter)
        tried = random.choice(rows, min(attempts, len(rows)) if len(rows) >= 10 else 1, replace=False)
        d = kernel(dist, sample[rows], sample[tried], **params)
        best = int(d.std(0, ddof=1).argmax())
        own = d[:, best]
        median = float(np.median(own))
        left, right = rows[own < median], rows[own >= median]
        if min(len(left), len(right)) < len(rows) / 4:
            return next(counter)  # ties at the median: no balanced split
        return Node(sample[tried[best] : tried[best] + 1], median, make(left), make(right))

    root = make(np.arange(len(sample)))
    return Tree(root, next(counter), dist, params)


def quantile_indices(values: np.ndarray, parts: int) -> np.ndarray:
    """Positions, in a sorted array, of the last value of each of ``parts`` parts of about equal size; equal values stay
    in one part, so that fewer parts may come out."""
    n = len(values)
    at = np.unique(np.minimum(n - 1, np.ceil(np.arange(1, parts + 1) * n / parts).astype(int) - 1))
    return np.unique(np.searchsorted(values, values[at], "right") - 1) if n else at[:0]


@dataclass
class VPTree:
    """Points with their leaf, stored in order of leaf, and the tree that put them there."""

    points: DataFrame
    tree: Tree
    payload: str

    @classmethod
    def build(cls, points: DataFrame, dist: str = "l2", payload: str = "vec", bucket: int = BUCKET, sample: int = SAMPLE, attempts: int = ATTEMPTS, path: str | None = None, **params) -> VPTree:
        """``bucket``: points of a leaf, about, in the whole table (more where the sample has no more leaves to give).

        Points are routed once and written, under ``path`` or in the shared folder.
        """
        n = points.count()
        rows = points.orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col(payload).alias("v")).toArrow()
        x = block(rows.column("v"), dist)
        tree = build_tree(x, dist, max(1, bucket * len(x) // max(n, 1)), attempts=attempts, **params)
        routed = _routed(points, tree, payload, "id")
        return cls(stored(routed.repartitionByRange("leaf").sortWithinPartitions("leaf"), "leaves", path), tree, payload)

    def save(self, path: str) -> None:
        """Writes the tree beside the points (and these, if they are kept elsewhere)."""
        spark = self.points.sparkSession
        if not any(f"{path}/leaves" in f for f in self.points.inputFiles()[:1]):
            stored(self.points.repartitionByRange("leaf").sortWithinPartitions("leaf"), "leaves", path)
        kind = self.points.schema[self.payload].dataType.simpleString()
        made = [(i, float(m), a, b, list(p)[0].tolist() if hasattr(list(p)[0], "tolist") else list(p)[0]) for i, m, a, b, p in self.tree.rows()]
        spark.createDataFrame(made, f"node int, median double, near int, far int, pivot {kind.replace('float', 'double')}").coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")

    @classmethod
    def load(cls, spark, path: str, dist: str, payload: str, **params) -> VPTree:
        """What ``save`` wrote: nothing is built."""
        nodes = spark.read.parquet(f"{path}/nodes").toArrow().sort_by("node")
        pivots = block(nodes.column("pivot"), dist)
        table = list(zip(nodes.column("median").to_pylist(), nodes.column("near").to_pylist(), nodes.column("far").to_pylist(), strict=True))

        def make(i: int) -> Node | int:
            return -1 - i if i < 0 else Node(pivots[i : i + 1], table[i][0], make(table[i][1]), make(table[i][2]))

        leaves = 1 + max((-1 - x for row in table for x in row[1:] if x < 0), default=0)
        return cls(spark.read.parquet(f"{path}/leaves"), Tree(make(0) if table else 0, leaves, dist, params), payload)

    def knn(self, queries: DataFrame, k: int, pruner: Pruner | None = None, max_leaves: int | None = None, eps: float = 0.0) -> DataFrame:
        """k nearest points; ``eps`` shrinks the radius of the second pass by 1 + eps."""
        out = None
        for part in query_blocks(queries, QUERIES):
            ids, q = collected(part, self.tree.dist, self.payload)
            found = top_k(self._scan(ids, q, self._asked(ids, q, k, pruner or Pruner(), max_leaves, eps), k=k), k)
            out = found if out is None else out.unionByName(found)
        return out

    def range_search(self, queries: DataFrame, radius: float, pruner: Pruner | None = None) -> DataFrame:
        out = None
        for part in query_blocks(queries, QUERIES):
            ids, q = collected(part, self.tree.dist, self.payload)
            found = self._scan(ids, q, self.tree.reach(q, np.full(len(ids), float(radius)), pruner or Pruner()), radius=float(radius))
            out = found if out is None else out.unionByName(found)
        return out

    def _asked(self, ids: np.ndarray, q, k: int, pruner: Pruner, most: int | None, eps: float = 0.0) -> np.ndarray:
        """Leaves to read for each query: those within the distance of the k-th point of its home leaf."""
        home = np.zeros((self.tree.leaves, len(ids)), bool)
        if len(ids):
            home[self.tree.route(q), np.arange(len(ids))] = True
        first = self._scan(ids, q, home, k=k)
        kth = top_k(first, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.max("dist") / (1 + eps)).alias("radius")).toArrow()  # a row a query
        radius = dict(zip(kth.column("query_id").to_pylist(), kth.column("radius").to_pylist(), strict=True))
        far = np.array([np.inf if radius.get(i) is None else radius[i] for i in ids.tolist()])
        return self.tree.reach(q, far, pruner, most)

    def _scan(self, ids: np.ndarray, q, asked: np.ndarray, k: int | None = None, radius: float | None = None, counted: bool = False) -> DataFrame:
        """Distances of each leaf's points to the queries that asked for it (a table of leaves and queries)."""
        spark, tree, payload = self.points.sparkSession, self.tree, self.payload
        ship(spark)
        wanted = np.flatnonzero(asked.any(1)).tolist()
        # a list of leaves prunes files and row groups; where nearly all are read it would only cost
        rows = self.points.where(F.col("leaf").isin(wanted)) if len(wanted) < min(MOST_LISTED, tree.leaves * 3 // 4) else self.points
        sent = spark.sparkContext.broadcast((ids, q, np.packbits(asked, axis=1)))
        dist, params = tree.dist, tree.params

        def run(batches):
            ids, q, bits = sent.value
            best, counts = Best(len(ids), k) if k and not counted else None, np.zeros(len(ids), np.int64)
            for batch in batches:
                leaf = batch.column("leaf").to_numpy()
                own = batch.column("id").to_numpy()
                cuts = [0, *(np.flatnonzero(leaf[1:] != leaf[:-1]) + 1).tolist(), len(leaf)] if len(leaf) else []
                for low, high in itertools.pairwise(cuts):
                    at = np.flatnonzero(np.unpackbits(bits[leaf[low]], count=len(ids)))
                    if not len(at):
                        continue
                    if counted:
                        counts[at] += high - low
                        continue
                    x = payloads(batch, dist, low, high)
                    step = columns(dist, x)
                    for a in range(0, len(at), step):
                        d = kernel(dist, x, q[at[a : a + step]], **params)
                        if best:
                            best.add(at[a : a + step], own[low:high], d)
                        else:
                            i, j = np.nonzero(d <= radius)
                            if len(i):
                                yield pa.RecordBatch.from_arrays([pa.array(ids[at[a + j]]), pa.array(own[low:high][i]), pa.array(d[i, j])], FOUND)
            if counted:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts)], ["query_id", "n"])
            elif best:
                yield best.batch(ids)

        return rows.select("id", "leaf", F.col(payload).alias("v")).mapInArrow(run, "query_id long, n long" if counted else FOUND_SCHEMA)

    def distance_computations(self, queries: DataFrame, k: int, pruner: Pruner | None = None) -> DataFrame:
        """Distances that the second pass computes for each query: (query_id, n)."""
        ids, q = collected(queries, self.tree.dist, self.payload)
        return self._scan(ids, q, self._asked(ids, q, k, pruner or Pruner(), None), k=k, counted=True).groupBy("query_id").agg(F.sum("n").alias("n"))


def _routed(rows: DataFrame, tree: Tree, payload: str, key: str) -> DataFrame:
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            x = block(batch.column("v"), tree.dist)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("v"), pa.array(tree.route(x) if len(x) else np.zeros(0, np.int32), pa.int32())], [key, payload, "leaf"])

    own = rows.select(F.col(key).cast("long").alias(key), F.col(payload).alias("v"))
    return own.mapInArrow(run, f"{key} long, `{payload}` {own.schema['v'].dataType.simpleString()}, leaf int")


def tune(index: VPTree, queries: DataFrame, gold: DataFrame, k: int, desired: float, step: float = 2.0, rounds: int = 4, exps: tuple[float, ...] = (1.0,), radius: float | None = None) -> tuple[Pruner, float, float]:
    """The pruner with the fewest distances whose mean recall is at least ``desired``.

    For each exponent a common alpha is found by bisection on a geometric grid; then each side's alpha alone is raised
    as far as the recall allows, the side that saves more first. With ``radius`` the answers are those of a range
    search. Gives the pruner, its recall and the mean number of distances of a query.
    """
    from .evaluation import recall, recall_in_range

    def measured(p: Pruner) -> tuple[float, float]:
        if radius is None:
            found = recall(gold, index.knn(queries, k, p), k).agg(F.avg("recall")).first()[0]
            return found, index.distance_computations(queries, k, p).agg(F.avg("n")).first()[0]
        found = recall_in_range(gold, index.range_search(queries, radius, p)).agg(F.avg("recall")).first()[0]
        ids, q = collected(queries, index.tree.dist, index.payload)
        asked = index.tree.reach(q, np.full(len(ids), float(radius)), p)
        return found, index._scan(ids, q, asked, counted=True).groupBy("query_id").agg(F.sum("n").alias("n")).agg(F.avg("n")).first()[0]

    def raised(make, low: float, best):
        """The largest factor on the grid, then by bisection, that keeps the recall."""
        high = low
        for _ in range(rounds):
            high *= step
            got = measured(make(high))
            if got[0] < desired:
                break
            low, best = high, (make(high), *got)
        else:
            return low, best
        for _ in range(rounds):
            middle = (low * high) ** 0.5
            got = measured(make(middle))
            if got[0] >= desired:
                low, best = middle, (make(middle), *got)
            else:
                high = middle
        return low, best

    outcomes = []
    for e in exps:
        start = Pruner(1.0, 1.0, e, e)
        common, best = raised(lambda a, e=e: Pruner(a, a, e, e), 1.0, (start, *measured(start)))
        sides = [raised(lambda a, e=e, c=common: Pruner(a, c, e, e), common, best)[1], raised(lambda a, e=e, c=common: Pruner(c, a, e, e), common, best)[1]]
        outcomes += [best, *sides]
    good = [o for o in outcomes if o[1] >= desired] or outcomes
    return min(good, key=lambda o: o[2])


__all__ = ["Node", "Pruner", "Tree", "VPTree", "build_tree", "quantile_indices", "tune"]
