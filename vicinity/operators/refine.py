"""Exact k-nearest-neighbour search by expressions, over the points that bounds of the distance cannot leave out.

A scan in Arrow batches keeps for each query the points whose lower bound is at most the k-th smallest upper bound;
the expression gives the distances of these, from the payloads of both tables, and they alone decide ranks and results.
Payloads that the bounds cannot read (null, NaN, of another length, ...) are all compared by the expression.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bounds import BOUNDS
from ..functions.distances import Pair, distance
from ..shipping import ship
from .knn import QUERY_BYTES, _union, pairs, query_blocks, top_k

#: Pairs that a task keeps before it drops those that nearer ones have overtaken.
KEPT = 1 << 20
#: If more than one in so many pairs of a block may be near, they are not sorted.
MANY = 32


class Near:
    """Pairs that may be among the k nearest of their query; of equal payloads the k smallest ids."""

    def __init__(self, n: int, k: int):
        self.k, self.high, self.found, self.n, self.most = k, np.full((n, k), np.inf), [], 0, KEPT

    def add(self, at: slice, own: np.ndarray, same: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Bounds of the queries ``at`` (rows) to points ``own`` (columns); ``same``: two hashes of each payload."""
        j, i = np.nonzero(low <= self.high[at, -1:])
        if not len(j):
            return
        old = self.high[at]
        if len(j) * MANY > low.size and high.shape[1] > self.k:  # the first blocks: the k smallest of all are found without a sort
            self.high[at] = np.sort(np.concatenate((old, np.partition(high, self.k - 1, axis=1)[:, : self.k]), 1), axis=1)[:, : self.k]
            j, i = np.nonzero(low <= self.high[at, -1:])
        else:
            value, row = np.concatenate((old.ravel(), high[j, i])), np.concatenate((np.repeat(np.arange(len(old)), self.k), j))
            order = np.lexsort((value, row))
            first = np.searchsorted(row[order], np.arange(len(old)))
            self.high[at] = value[order][first[:, None] + np.arange(self.k)]
        keep = low[j, i] <= self.high[at, -1][j]
        j, i = j[keep], i[keep]
        self.found.append((at.start + j, own[i], low[j, i], high[j, i], *same[:, i]))
        self.n += len(j)
        if self.n > self.most:
            self.compact()
            self.most = max(KEPT, 2 * self.n)

    def compact(self) -> None:
        if not self.found:
            return
        j, i, low, high, a, b = (np.concatenate(x) for x in zip(*self.found, strict=True))
        at = np.flatnonzero(low <= self.high[j, -1])
        at = at[np.lexsort((i[at], b[at], a[at], j[at]))]
        new = np.ones(len(at), bool)
        new[1:] = (j[at][1:] != j[at][:-1]) | (a[at][1:] != a[at][:-1]) | (b[at][1:] != b[at][:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        at = at[np.arange(len(at)) - start < self.k]
        self.found, self.n = [tuple(x[at] for x in (j, i, low, high, a, b))], len(at)


NEAR = "query_id long, id long, low double, high double"


def _dealt(points: DataFrame) -> DataFrame:
    """Points of a table that few tasks would read, dealt over all cores."""
    spark = points.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = points._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return points.repartition(cores, "id") if size < cores * split else points


def _near(points: DataFrame, ids: np.ndarray, rows: list[np.ndarray], k: int, form, shape: list[int], payload: str) -> DataFrame:
    """Pairs (query_id, id) that may be among the k nearest."""
    ship(points.sparkSession)
    sent = points.sparkSession.sparkContext.broadcast((ids, rows))

    def run(batches):
        ids, rows = sent.value
        blocks, near = form.prepare(rows), Near(len(ids), k)
        for batch in batches:
            own, same = batch.column("id").to_numpy(), np.stack([batch.column(c).to_numpy() for c in "ab"])
            x = form.read(batch.column("v"), shape) if batch.num_rows else []
            for at, block in blocks:
                step = form.step(block)
                for a in range(0, batch.num_rows, step):
                    b = slice(a, min(a + step, batch.num_rows))
                    near.add(at, own[b], same[:, b], *form.bounds([part[b] for part in x], block))
        near.compact()
        for j, i, low, high, _, _ in near.found:
            yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(i), pa.array(low), pa.array(high)], ["query_id", "id", "low", "high"])

    v, points = F.col(payload), _dealt(points)
    # equal payloads have equal distances; 128 bits of hashes tell payloads apart
    found = points.where(form.plain(v, shape)).select(F.col("id").cast("long").alias("id"), v.alias("v"), F.xxhash64(v).alias("a"), F.xxhash64(F.lit(1), v).alias("b")).mapInArrow(run, NEAR)
    by = Window.partitionBy("query_id")
    ranked = found.withColumn("_r", F.row_number().over(by.orderBy("high", "id")))
    return ranked.withColumn("_most", F.max(F.when(F.col("_r") <= k, F.col("high"))).over(by)).where(F.col("low") <= F.col("_most")).select("query_id", "id")


def _refined(points: DataFrame, queries: DataFrame, k: int, f: Pair, form, payload: str) -> DataFrame:
    """Distances of one block of queries to the points that may be among the k nearest, and some others."""
    v = F.col(payload)
    shapes = {tuple(r["s"]): r["count"] for r in queries.groupBy(form.shape(v).alias("s")).count().collect()}
    shapes = {s: n for s, n in shapes.items() if None not in s}
    if not shapes:
        return pairs(points, queries, f, payload)
    shape = list(max(shapes, key=shapes.get))  # the most frequent one
    plain = form.plain(v, shape)
    table = queries.where(plain).select(F.col("query_id").cast("long").alias("query_id"), v.alias("v")).toArrow().combine_chunks()
    if table.nbytes > QUERY_BYTES:
        raise ValueError("a block of queries is too large to broadcast; use fewer queries at a time")
    out = [pairs(points.where(~plain), queries, f, payload)]
    if odd := queries.where(~plain).count():
        out.append(pairs(points.where(plain), queries.where(~plain), f, payload))
    if table.num_rows:
        column = pa.concat_arrays(table.column("v").chunks)
        near = _near(points, table.column("query_id").to_numpy(), form.read(column, shape), k, form, shape, payload)
        q = queries.where(plain).select("query_id", v.alias("_q")) if odd else queries.select("query_id", v.alias("_q"))
        both = points.select("id", v.alias("_v")).join(F.broadcast(near), "id").join(F.broadcast(q), "query_id")
        out.append(both.select("query_id", "id", f(F.col("_v"), F.col("_q")).alias("dist")))
    return _union(out)


def knn_refined(points: DataFrame, queries: DataFrame, k: int, dist: Pair | str, payload: str = "vec", bounds=None, **params) -> DataFrame:
    """The same result as ``knn``, by the expression of a space that has bounds, or by an expression and its ``bounds``."""
    if bounds is None:
        if dist not in BOUNDS:
            raise ValueError(f"space {dist!r} has no bounds")
        bounds = BOUNDS[dist](**params)
    f = distance(dist, **params) if isinstance(dist, str) else dist
    return _union(top_k(_refined(points, b, k, f, bounds, payload), k) for b in query_blocks(queries))
