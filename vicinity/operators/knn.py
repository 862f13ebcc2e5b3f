"""Exact k-nearest-neighbour and range queries as plans, and the classification that uses them.

Points are rows (id, payload), queries rows (query_id, payload). Results are (query_id, rank, id, dist), ranked by
distance and id, or (query_id, id, dist) for ranges, which include the radius. Spaces with a block form are scanned
in Arrow batches against a broadcast block of queries of a checked size; all other distances are expressions. Per
task only the best k of each query go on, so a result never grows with points x queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distances import Pair, distance
from ..functions.kernels import BATCHED, KERNELS, block, is_matrix, kernel
from ..shipping import ship

#: Queries that are broadcast at once, their bytes, and blocks of them in one plan, at most.
QUERY_BLOCK = 1 << 14
QUERY_BYTES = 1 << 28
BLOCKS = 64
#: Points and queries of a block of distances, and numbers in one where differences of all coordinates are held.
ROWS, COLUMNS, CELLS = 1024, 512, 1 << 22
#: Spaces whose blocks hold such differences.
DIFFERENCES = ("l1", "linf", "lp", "l2sqr_sift", "footrule", "spearman_rho", "bit_hamming", "bit_jaccard")
#: Spaces whose expressions run faster than their block form (a loop over pairs).
PAIRWISE = ("leven", "normleven")


def top_k(pairs: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best rows (dist, id) of each query, ranked from 1."""
    order = Window.partitionBy(by).orderBy("dist", "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(by, "rank", "id", "dist")


def query_blocks(queries: DataFrame, block: int = QUERY_BLOCK) -> Iterator[DataFrame]:
    """The queries in parts of a bounded size, by a hash of their id."""
    n = queries.count()
    if n <= block:
        yield queries
        return
    parts = -(-2 * n // block)
    if parts > BLOCKS:
        raise ValueError(f"{n} queries are too many for a scan of all points; join them by a graph index instead (operators.graphs)")
    for i in range(parts):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)


def collected(queries: DataFrame, dist: str, payload: str = "vec") -> tuple[np.ndarray, object]:
    """Ids and payloads of one block of queries, as what ``kernel`` takes."""
    table = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col(payload).alias("v")).toArrow()
    if table.nbytes > QUERY_BYTES:
        raise ValueError("a block of queries is too large to broadcast; use fewer queries at a time")
    return table.column("query_id").to_numpy(), block(table.column("v"), dist)


def _union(frames) -> DataFrame:
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df)
    return out


def _pair(dist: Pair | str, params: dict | None) -> Pair:
    return distance(dist, **(params or {})) if isinstance(dist, str) else dist


def pairs(points: DataFrame, queries: DataFrame, dist: Pair | str, payload: str = "vec", **params) -> DataFrame:
    """Distances of all points to the queries of one block: (query_id, id, dist)."""
    f = _pair(dist, params)
    q = queries.select("query_id", F.col(payload).alias("_q"))
    return points.select("id", F.col(payload).alias("_v")).join(F.broadcast(q), how="cross").select("query_id", "id", f(F.col("_v"), F.col("_q")).alias("dist"))


def knn(points: DataFrame, queries: DataFrame, k: int, dist: Pair | str = "l2", payload: str = "vec", **params) -> DataFrame:
    """Exact k nearest points of every query, by distance expressions."""
    return _union(top_k(pairs(points, b, dist, payload, **params), k) for b in query_blocks(queries))


def knn_distinct(points: DataFrame, queries: DataFrame, k: int, dist: Pair | str, payload: str = "vec", **params) -> DataFrame:
    """The same result as ``knn`` for payloads that repeat: distances of distinct queries to the k smallest ids of each distinct payload."""
    place = F.row_number().over(Window.partitionBy(payload).orderBy("id"))
    few = points.select("id", payload, place.alias("_n")).where(F.col("_n") <= k).drop("_n")
    asked = queries.groupBy(payload).agg(F.min("query_id").alias("query_id"))
    found = knn(few, asked, k, dist, payload, **params).withColumnRenamed("query_id", "_asked")
    same = queries.select("query_id", F.col(payload).alias("_q")).join(asked.select(F.col("query_id").alias("_asked"), F.col(payload).alias("_v")), F.col("_q").eqNullSafe(F.col("_v")))
    return same.join(found, "_asked").select("query_id", "rank", "id", "dist")


def range_search(points: DataFrame, queries: DataFrame, radius: float, dist: Pair | str = "l2", payload: str = "vec", **params) -> DataFrame:
    """All points within the radius of every query, by distance expressions."""
    return _union(pairs(points, b, dist, payload, **params).where(F.col("dist") <= radius) for b in query_blocks(queries))


class Best:
    """The k nearest points of each query so far, by distance (NaN last) and id."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, n: int, k: int):
        self.k, self.d, self.i = k, np.full((n, k), np.nan), np.full((n, k), self.NONE)

    def add(self, queries: np.ndarray | slice, own: np.ndarray, d: np.ndarray) -> None:
        """Distances ``d`` of points ``own`` (rows) to some queries (columns)."""
        if len(own) > 4 * self.k:  # all but the nearest k of each query can go; ties with the last one stay
            cut = np.partition(np.where(np.isnan(d), np.inf, d), self.k - 1, axis=0)[self.k - 1]
            some = (~(d > cut)).any(1)
            own, d = own[some], d[some]
        dd = np.concatenate((self.d[queries], d.T), 1)
        ii = np.concatenate((self.i[queries], np.broadcast_to(own, (d.shape[1], len(own)))), 1)
        order = np.lexsort((ii, dd), axis=1)[:, : self.k]
        self.d[queries], self.i[queries] = np.take_along_axis(dd, order, 1), np.take_along_axis(ii, order, 1)

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        at = self.i != self.NONE
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, at.sum(1))), pa.array(self.i[at]), pa.array(self.d[at])], FOUND)


FOUND = ["query_id", "id", "dist"]
FOUND_SCHEMA = "query_id long, id long, dist double"


def _rows(points: DataFrame, dist: str, payload: str) -> DataFrame:
    v = F.col(payload).cast("array<double>") if is_matrix(dist) else F.col(payload)
    return points.select(F.col("id").cast("long").alias("id"), v.alias("v"))


def payloads(batch, dist: str, low: int, high: int):
    """Rows of an Arrow batch as what ``kernel`` takes; equally long vectors without a detour through Python values."""
    column = batch.column("v").slice(low, high - low)
    if is_matrix(dist) and not column.null_count and len(column):
        flat = column.flatten()
        if len(flat) % len(column) == 0 and not flat.null_count:
            return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return block(column, dist)


def columns(dist: str, x) -> int:
    """Queries of a block with the points x."""
    return COLUMNS if dist not in DIFFERENCES or not len(x) else max(1, CELLS // (len(x) * max(1, len(x[0]))))


def scan(points: DataFrame, queries: DataFrame, dist: str, payload: str, params: dict, k: int | None = None, radius: float | None = None) -> DataFrame:
    """One block of queries against all points in blocks of distances: the best k of each task, or all within the radius."""
    ship(points.sparkSession)
    ids, q = collected(queries, dist, payload)
    sent = points.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches):
        ids, q = sent.value
        best = Best(len(ids), k) if k else None
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                high = min(low + ROWS, batch.num_rows)
                x, own = payloads(batch, dist, low, high), batch.column("id").to_numpy()[low:high]
                step = columns(dist, x)
                for a in range(0, len(ids), step):
                    d = kernel(dist, x, q[a : a + step], **params)
                    if best:
                        best.add(slice(a, a + d.shape[1]), own, d)
                    else:
                        i, j = np.nonzero(d <= radius)
                        if len(i):
                            yield pa.RecordBatch.from_arrays([pa.array(ids[a + j]), pa.array(own[i]), pa.array(d[i, j])], FOUND)
        if best:
            yield best.batch(ids)

    return _rows(points, dist, payload).mapInArrow(run, FOUND_SCHEMA)


def knn_blocks(points: DataFrame, queries: DataFrame, k: int, dist: str = "l2", payload: str = "vec", **params) -> DataFrame:
    """The same result as ``knn``, from blocks of distances over Arrow batches."""
    if dist not in KERNELS:
        raise ValueError(f"space {dist!r} has no block form")
    return _union(top_k(scan(points, b, dist, payload, params, k), k) for b in query_blocks(queries))


def knn_batched(points: DataFrame, queries: DataFrame, k: int, dist: str = "l2", payload: str = "vec") -> DataFrame:
    """``knn_blocks`` for the spaces whose blocks are matrix products."""
    if dist not in BATCHED:
        raise ValueError(f"space {dist!r} has no matrix form")
    return knn_blocks(points, queries, k, dist, payload)


def in_blocks(dist: Pair | str) -> bool:
    return isinstance(dist, str) and dist in KERNELS and dist not in PAIRWISE


def search(points: DataFrame, queries: DataFrame, k: int, dist: str = "l2", payload: str = "vec", params: dict | None = None) -> DataFrame:
    """k nearest points by the cheapest exact plan for the space."""
    params = params or {}
    return knn_blocks(points, queries, k, dist, payload, **params) if in_blocks(dist) else knn(points, queries, k, distance(dist, **params), payload)


def search_range(points: DataFrame, queries: DataFrame, radius: float, dist: str = "l2", payload: str = "vec", params: dict | None = None) -> DataFrame:
    """All points within the radius by the cheapest exact plan for the space."""
    if not in_blocks(dist):
        return range_search(points, queries, radius, distance(dist, **(params or {})), payload)
    return _union(scan(points, b, dist, payload, params or {}, radius=radius) for b in query_blocks(queries))


def knn_graph(points: DataFrame, k: int, dist: str = "l2", payload: str = "vec") -> DataFrame:
    """The k nearest points of each point itself included, in blocks of queries (``QUERY_BLOCK * BLOCKS / 2`` points at most)."""
    return search(points, points.select(F.col("id").alias("query_id"), payload), k, dist, payload)


def classify(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """The most frequent label among each query's neighbours; of equally frequent ones the smallest."""
    votes = neighbours.join(labels.select("id", "label"), "id").groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    best = votes.groupBy("query_id").agg(F.max(F.struct("votes", (-F.col("label")).alias("_l"))).alias("_b"))
    return best.select("query_id", (-F.col("_b._l")).alias("label"), F.col("_b.votes").alias("votes"))


__all__ = ["classify", "knn", "knn_batched", "knn_blocks", "knn_distinct", "knn_graph", "range_search", "search", "search_range", "top_k"]
