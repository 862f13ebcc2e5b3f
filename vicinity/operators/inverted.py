"""Inverted files over sparse vectors, and candidate generation from shared nearest pivots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distances import Pair, distance
from ..functions.kernels import BATCHED, KERNELS, block, kernel
from ..shipping import ship
from .knn import FOUND, FOUND_SCHEMA, Best, collected, payloads, query_blocks, top_k

#: Spaces whose distance follows from the inner product and the norms, by the part of their name before ``_sparse``.
PRODUCTS = ("negdotprod", "querynorm_negdotprod", "cosinesimil", "angulardist")
TINY = 2 * np.finfo(np.float32).tiny
#: Pivots that are broadcast, at most.
MOST_PIVOTS = 1 << 14


def postings(points: DataFrame, payload: str = "vec") -> DataFrame:
    """One row for each entry of each sparse vector: key, id, val and the squared norm of the vector."""
    norm = F.aggregate(F.col(payload), F.lit(0.0), lambda a, e: a + e["val"].cast("double") * e["val"])
    return points.select("id", norm.alias("norm"), F.explode(payload).alias("_e")).select(F.col("_e.dim").alias("key"), "id", F.col("_e.val").cast("double").alias("val"), "norm")


def _from_product(base: str):
    """The distance in a space from the inner product and both squared norms."""

    def cosine(p, x, q):
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when((x >= TINY) & (q >= TINY), p / (F.sqrt(x) * F.sqrt(q))).otherwise(F.lit(0.0))))

    return {
        "negdotprod": lambda p, x, q: -p,
        "querynorm_negdotprod": lambda p, x, q: -p / F.sqrt(F.greatest(q, F.lit(TINY))),
        "cosinesimil": lambda p, x, q: F.greatest(F.lit(0.0), 1 - cosine(p, x, q)),
        "angulardist": lambda p, x, q: F.acos(cosine(p, x, q)),
    }[base]


def product_space(dist: str) -> str:
    """The base name of a space that the inverted file answers; an error for others."""
    base = dist.split("_sparse")[0]
    if base not in PRODUCTS:
        raise ValueError(f"an inverted file answers the spaces of inner products ({', '.join(PRODUCTS)}), not {dist!r}")
    return base


def inverted_knn(posted: DataFrame, queries: DataFrame, k: int, payload: str = "vec", dist: str = "negdotprod_sparse_fast") -> DataFrame:
    """Best k points by the space's distance among those that share a term; an empty result without any."""
    f = _from_product(product_space(dist))
    norm = F.aggregate(F.col(payload), F.lit(0.0), lambda a, e: a + e["val"].cast("double") * e["val"])
    terms = queries.select("query_id", norm.alias("_n"), F.explode(payload).alias("_e")).select(F.col("_e.dim").alias("key"), "query_id", F.col("_e.val").cast("double").alias("_w"), "_n")
    scored = posted.join(terms, "key").groupBy("query_id", "id").agg(F.sum(F.col("val") * F.col("_w")).alias("_p"), F.first("norm").alias("_x"), F.first("_n").alias("_q"))
    return top_k(scored.select("query_id", "id", f(F.col("_p"), F.col("_x"), F.col("_q")).alias("dist")), k)


def choose_pivots(points: DataFrame, n: int, payload: str = "vec") -> DataFrame:
    """``n`` points as pivots, those of the smallest MD5 of their id; numbered from 0 in order of id."""
    if n >= points.count():
        raise ValueError("there must be fewer pivots than points")
    if n > MOST_PIVOTS:
        raise ValueError(f"at most {MOST_PIVOTS} pivots")
    chosen = points.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(n).select(F.col("id").alias("_id"), payload)
    return chosen.select((F.row_number().over(Window.orderBy("_id")) - 1).alias("pivot_id"), payload)  # n rows


def _pivot_block(pivots: DataFrame, dist: str, payload: str):
    """Ids and payloads of the pivots in order, on the driver: there are ``MOST_PIVOTS`` at most."""
    table = pivots.select(F.col("pivot_id").cast("int").alias("pivot_id"), F.col(payload).alias("v")).toArrow().sort_by("pivot_id")
    if len(table) > MOST_PIVOTS:
        raise ValueError(f"at most {MOST_PIVOTS} pivots")
    return table.column("pivot_id").to_numpy(), block(table.column("v"), dist)


def _places(x, pivots, dist: str, params: dict, n: int) -> np.ndarray:
    """Positions of the n nearest pivots of each row, nearest first, the smaller id among equals; the pivot is the object."""
    d = kernel(dist, pivots, x, **params).T
    return np.lexsort((np.broadcast_to(np.arange(d.shape[1]), d.shape), d), axis=1)[:, :n]


def with_prefix(points: DataFrame, pivots: DataFrame, dist: str, n: int, payload: str = "vec", name: str = "prefix", indexed: str | None = None, **params) -> DataFrame:
    """Adds the ids of the n nearest pivots, nearest first: all distances of a row are computed where it is.

    ``indexed``: the column that meets the pivots, if it is not the payload.
    """
    if dist not in KERNELS:
        raise ValueError(f"space {dist!r} has no block form")
    ship(points.sparkSession)
    sent = points.sparkSession.sparkContext.broadcast(_pivot_block(pivots, dist, payload))
    names, own = points.columns, points.columns.index(indexed or payload)

    def run(batches):
        numbers, matrix = sent.value
        for batch in batches:
            part = [numbers[_places(payloads(pa.record_batch([batch.column(own)], ["v"]), dist, low, min(low + 1024, batch.num_rows)), matrix, dist, params, n)] for low in range(0, batch.num_rows, 1024)]
            rows = np.concatenate(part) if part else np.zeros((0, min(n, len(numbers))), np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(rows.astype(np.int32)), pa.list_(pa.int32()))], [*names, name])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in points.schema.fields)
    return points.mapInArrow(run, f"{fields}`{name}` array<int>")


def pivot_distances(points: DataFrame, pivots: DataFrame, dist: Pair | str, payload: str = "vec") -> DataFrame:
    """Distances of every point to all pivots, the pivot as the object: (id, pivot_id, dist). Pivots are few and broadcast."""
    f = distance(dist) if isinstance(dist, str) else dist
    p = pivots.limit(MOST_PIVOTS).select("pivot_id", F.col(payload).alias("_p"))
    return points.select("id", F.col(payload).alias("_v")).join(F.broadcast(p), how="cross").select("id", "pivot_id", f(F.col("_p"), F.col("_v")).alias("dist"))


def permutation_prefix(prefixed: DataFrame, name: str = "prefix") -> DataFrame:
    """The nearest pivots of rows of ``with_prefix`` with their place from 1: (id, place, pivot_id). Nothing is shuffled."""
    return prefixed.select("id", F.posexplode(name).alias("_i", "pivot_id")).select("id", (F.col("_i") + 1).alias("place"), "pivot_id")


def permutation(prefixed: DataFrame, name: str = "prefix") -> DataFrame:
    """The rank of every pivot for each point, in order of pivot: (id, ranks); takes prefixes of all pivots."""
    places = F.transform(F.array_sort(F.transform(F.col(name), lambda p, i: F.struct(p.alias("p"), i.alias("i")))), lambda e: e["i"])
    return prefixed.select("id", places.alias("ranks"))


def candidates(posted: DataFrame, query_prefix: DataFrame, least: int) -> DataFrame:
    """Points that share at least ``least`` nearest pivots with a query: (query_id, id, shared)."""
    q = query_prefix.select(F.col("id").alias("query_id"), "pivot_id")
    return posted.select("id", "pivot_id").join(q, "pivot_id").groupBy("query_id", "id").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def shared_scan(prefixed: DataFrame, queries: DataFrame, pivots: DataFrame, dist: str = "l2", payload: str = "vec", least: int = 2, search_prefix: int = 32, k: int | None = None, radius: float | None = None, budget: int | None = None, by_shared: bool = False, index_space: str | None = None, index_pivots: DataFrame | None = None, query_index: str | None = None, **params) -> DataFrame:
    """One pass over points with stored prefixes (id, payload, prefix): counts the pivots that each shares with each
    query, by products of membership matrices, and computes distances of those with enough.

    The best k of each task go on, or all within the radius; ``budget``: only the points that share most are checked
    (a first pass finds how much that is); ``by_shared``: ranks by what is shared and computes no distance.
    """
    ship(prefixed.sparkSession)
    spark = prefixed.sparkSession
    out = None
    space = index_space or dist
    numbers, matrix = _pivot_block(index_pivots if index_pivots is not None else pivots, space, payload)
    for part in query_blocks(queries, 4096):
        ids, q = collected(part, dist, payload)
        asked = q if query_index is None else collected(part, space, query_index)[1]
        places = _places(asked, matrix, space, params, search_prefix) if len(ids) else np.zeros((0, 0), np.int64)
        member = np.zeros((len(ids), len(numbers)), np.float32)
        if len(ids):
            np.put_along_axis(member, places, 1, 1)
        at = np.full(int(numbers.max(initial=0)) + 1, -1)
        at[numbers] = np.arange(len(numbers))
        enough = np.full(len(ids), least, np.float32)
        shared = lambda prefix, at=at, member=member: _shared(prefix, at, member)
        if budget is not None:
            enough = np.maximum(enough, _cuts(prefixed, shared, len(ids), len(numbers), budget, least))
        sent = spark.sparkContext.broadcast((ids, q, enough))

        def run(batches, sent=sent, shared=shared):
            ids, q, enough = sent.value
            best = Best(len(ids), k) if k else None
            for batch in batches:
                for low in range(0, batch.num_rows, 1024):
                    high = min(low + 1024, batch.num_rows)
                    counts = shared(batch.column("prefix").slice(low, high - low))
                    good = counts >= enough[None, :]
                    own = batch.column("id").to_numpy()[low:high]
                    rows = np.flatnonzero(good.any(1))
                    if not len(rows):
                        continue
                    good, own = good[rows], own[rows]
                    if by_shared:
                        d = -counts[rows].astype(np.float64)
                    elif dist in BATCHED:
                        d = kernel(dist, payloads(batch, dist, low, high)[rows], q, **params)
                    else:
                        x = payloads(batch, dist, low, high)[rows]
                        d = np.full(good.shape, np.nan)
                        for j in np.flatnonzero(good.any(0)):
                            d[good[:, j], j] = kernel(dist, x[good[:, j]], q[j : j + 1], **params)[:, 0]
                    if best is None:
                        i, j = np.nonzero(good & (d <= radius))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(own[i]), pa.array(d[i, j])], FOUND)
                    else:
                        for j in np.flatnonzero(good.any(0)):
                            best.add(np.array([j]), own[good[:, j]], d[good[:, j], j][:, None])
            if best:
                yield best.batch(ids)

        rows = prefixed.select(F.col("id").cast("long").alias("id"), F.col(payload).alias("v"), "prefix")
        found = rows.mapInArrow(run, FOUND_SCHEMA)
        found = top_k(found, k) if k else found
        out = found if out is None else out.unionByName(found)
    return out


def _shared(prefix, at: np.ndarray, member: np.ndarray) -> np.ndarray:
    """How many pivots each row's prefix shares with each query's."""
    n = len(prefix)
    width = np.diff(prefix.offsets.to_numpy())
    flat = prefix.flatten().to_numpy(zero_copy_only=False)
    m = np.zeros((n, member.shape[1]), np.float32)
    m[np.repeat(np.arange(n), width), at[flat]] = 1
    return m @ member.T


def _cuts(prefixed: DataFrame, shared, n: int, width: int, budget: int, least: int) -> np.ndarray:
    """The smallest count of shared pivots that no more than ``budget`` points of each query reach, or ``least``: from histograms."""

    def run(batches):
        total = np.zeros((n, width + 1), np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                counts = shared(batch.column("prefix").slice(low, 1024)).astype(np.int64)
                np.add.at(total, (np.broadcast_to(np.arange(n), counts.shape), counts), 1)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["query", "shared", "points"])

    rows = prefixed.select("prefix").mapInArrow(run, "query long, shared long, points long").groupBy("query", "shared").agg(F.sum("points").alias("points")).toArrow()
    total = np.zeros((n, width + 1), np.int64)
    total[rows.column("query").to_numpy(), rows.column("shared").to_numpy()] = rows.column("points").to_numpy()
    above = total[:, ::-1].cumsum(1)[:, ::-1]
    # at least the points of the highest count that occurs are checked
    fits = above <= np.maximum(budget, np.where(total > 0, above, np.iinfo(np.int64).max).min(1))[:, None]
    return np.maximum(fits.argmax(1), least).astype(np.float32)


def napp_knn(points: DataFrame, queries: DataFrame, pivots: DataFrame, k: int, dist: str = "l2", payload: str = "vec", num_pivot_index: int = 32, num_prefix_search: int | None = None, num_pivot_search: int = 2, budget: int | None = None, skip_checking: bool = False, **params) -> DataFrame:
    """k nearest of the candidates that share enough pivots, checked exactly (unless told to rank by what they share)."""
    prefixed = with_prefix(points.select("id", payload), pivots, dist, num_pivot_index, payload, **params)
    return shared_scan(prefixed, queries, pivots, dist, payload, num_pivot_search, num_prefix_search or num_pivot_index, k=k, budget=budget, by_shared=skip_checking, **params)


def napp_range(points: DataFrame, queries: DataFrame, pivots: DataFrame, radius: float, dist: str = "l2", payload: str = "vec", num_pivot_index: int = 32, num_pivot_search: int = 2, **params) -> DataFrame:
    """Candidates within the radius."""
    prefixed = with_prefix(points.select("id", payload), pivots, dist, num_pivot_index, payload, **params)
    return shared_scan(prefixed, queries, pivots, dist, payload, num_pivot_search, num_pivot_index, radius=radius, **params)
