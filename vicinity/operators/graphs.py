"""Proximity-graph search: a graph for each part of the points, searched by every query, answers merged by top k.

Building a graph is sequential, so points are dealt to parts of a bounded size by a hash of their id; parts build
and search independently, and recall is that of the parts together. ``sw-graph`` links a new point to its nearest
known ones both ways; ``hnsw`` adds levels and chooses neighbours that are not closer to each other than to the point.

A graph is built once and kept as one row: ids, payloads and links of its part, as Arrow bytes. A search maps over
these rows and shuffles nothing but the best k of each part; points are added to the stored graphs and deleted from
them part by part. Edges can be had as a table too.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distances import distance
from ..functions.kernels import block, kernel
from ..shipping import ship
from ..storage import stored
from .knn import FOUND, FOUND_SCHEMA, collected, query_blocks, top_k

#: Points of a part, about, and queries of a block.
PART = 5000
QUERIES = 4096


@dataclass
class Graph:
    """Links between rows of a matrix, by level; level 0 has all rows."""

    x: np.ndarray
    dist: str
    m: int = 16
    ef: int = 200
    layered: bool = True
    choose: int = 2
    seed: int = 0
    params: dict = field(default_factory=dict)
    most: int | None = None
    most0: int | None = None
    mult: float | None = None
    post: int = 0
    proxy: bool = False
    links: list[dict[int, list[int]]] = field(default_factory=list)
    entry: int = -1

    def _d(self, rows: list[int], q: np.ndarray) -> np.ndarray:
        """Distances of rows, as objects, to one query (a block of one); while building with ``proxy``, the mean of both directions."""
        d = kernel(self.dist, self.x[rows], q, **self.params)[:, 0]
        return (d + kernel(self.dist, q, self.x[rows], **self.params)[0]) / 2 if self.proxy else d

    def _beam(self, q: np.ndarray, start: list[tuple[float, int]], width: int, level: int) -> list[tuple[float, int]]:
        """The nearest rows that a best-first walk over one level meets, nearest first."""
        seen = {i for _, i in start}
        open_ = list(start)
        heapq.heapify(open_)
        best = [(-d, -i) for d, i in start]
        heapq.heapify(best)
        while open_:
            d, i = heapq.heappop(open_)
            if len(best) >= width and d > -best[0][0]:
                break
            fresh = [j for j in self.links[level].get(i, ()) if j not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for e, j in zip(self._d(fresh, q).tolist(), fresh, strict=True):
                if len(best) < width or e < -best[0][0]:
                    heapq.heappush(open_, (e, j))
                    heapq.heappush(best, (-e, -j))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-d, -i) for d, i in best)

    def _select(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours of a row from candidates, nearest first: plain, or those nearer to the row than to any chosen one."""
        if self.choose == 0 or len(found) <= 1:
            return [i for _, i in found[:most]]
        kept: list[int] = []
        passed: list[int] = []
        for d, i in found:
            if len(kept) == most:
                break
            if not kept or self._d(kept, self.x[i : i + 1]).min() > d:
                kept.append(i)
            else:
                passed.append(i)
        if self.choose == 1:  # the nearest passed ones fill up
            kept += passed[: most - len(kept)]
        elif self.choose == 3 and kept:  # they fill up by what each adds: the one furthest from all that are kept
            while passed and len(kept) < most:
                gap = [float(self._d(kept, self.x[i : i + 1]).min()) for i in passed]
                kept.append(passed.pop(int(np.argmax(gap))))
        return kept

    def _link(self, level: int, i: int, to: list[int]) -> None:
        most = ((self.most0 or 2 * self.m) if level == 0 else (self.most or self.m)) if self.layered else None
        table = self.links[level]
        table[i] = list(to)
        for j in to:
            own = table.setdefault(j, [])
            if i not in own:
                own.append(i)
            if most is not None and len(own) > most:
                d = self._d(own, self.x[j : j + 1])
                table[j] = self._select(sorted(zip(d.tolist(), own, strict=True)), most)

    def _insert(self, i: int, top: int) -> None:
        q = self.x[i : i + 1]
        if self.entry >= 0:
            at = [(float(self._d([self.entry], q)[0]), self.entry)]
            for level in range(len(self.links) - 1, -1, -1):
                if level > top:
                    at = self._beam(q, at, 1, level)[:1]
                else:
                    at = self._beam(q, at, self.ef, level)
                    self._link(level, i, self._select(at, self.m))
        while len(self.links) <= top:
            self.links.append({i: []})
            self.entry = i

    def extend(self, rows: range) -> Graph:
        """Inserts rows of the matrix one after another."""
        random = np.random.default_rng((self.seed, rows.start))
        scale = self.mult if self.mult is not None else 1 / math.log(max(self.m, 2))
        levels = np.floor(-np.log(1 - random.random(len(rows))) * scale).astype(int) if self.layered else np.zeros(len(rows), int)
        for i, top in zip(rows, levels.tolist(), strict=True):
            self._insert(i, top)
        return self

    def build(self) -> Graph:
        self.extend(range(len(self.x)))
        for _ in range(self.post):
            self._reselect()
        self.proxy = False
        return self

    def _reselect(self) -> None:
        """Once all rows are known, each row's neighbours on level 0 are searched and chosen anew; the old ones stay candidates."""
        if self.entry < 0 or not self.layered:
            return
        most = self.most0 or 2 * self.m
        for i in sorted(self.links[0]):
            met = {j: d for d, j in self._beam(self.x[i : i + 1], [(float(self._d([self.entry], self.x[i : i + 1])[0]), self.entry)], self.ef, 0) if j != i}
            own = [j for j in self.links[0][i] if j not in met]
            met |= dict(zip(own, self._d(own, self.x[i : i + 1]).tolist(), strict=True)) if own else {}
            self._link(0, i, self._select(sorted((d, j) for j, d in met.items()), min(self.m, most)))

    def remove(self, gone: set[int], patch: bool = True) -> None:
        """Takes rows out. With ``patch`` each neighbour of a removed row is linked to that row's nearest surviving neighbour."""
        for table in self.links:
            for i in [i for i in table if i in gone]:
                left = [j for j in table.pop(i) if j not in gone]
                if patch and len(left) > 1:
                    for j in left:
                        others = [o for o in left if o != j]
                        near = others[int(np.argmin(self._d(others, self.x[j : j + 1])))]
                        for a, b in ((j, near), (near, j)):
                            if b not in table.setdefault(a, []):
                                table[a].append(b)
            for i, to in table.items():
                table[i] = [j for j in to if j not in gone]
        while self.links and not self.links[-1]:
            self.links.pop()
        if self.entry in gone:
            self.entry = min(self.links[-1], default=-1) if self.links else -1

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        at = [(float(self._d([self.entry], q)[0]), self.entry)]
        for level in range(len(self.links) - 1, 0, -1):
            at = self._beam(q, at, 1, level)[:1]
        return self._beam(q, at, max(ef, k), 0)[:k]


def packed(ids: np.ndarray, column: pa.Array, g: Graph) -> bytes:
    """A graph as Arrow bytes: one row for each point with its links by level."""
    levels = [[table.get(i) for table in g.links] for i in range(len(ids))]
    table = pa.table({"id": pa.array(ids, pa.int64()), "v": column, "links": pa.array(levels, pa.list_(pa.list_(pa.int32())))}, metadata=None)
    table = table.replace_schema_metadata({"entry": str(g.entry)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes, blank: Graph) -> tuple[np.ndarray, pa.ChunkedArray, Graph]:
    """Ids, payloads and the graph of a row; ``blank`` has the parameters."""
    table = pa.ipc.open_stream(data).read_all()
    g = replace(blank, x=block(table.column("v"), blank.dist), links=[], entry=int(table.schema.metadata[b"entry"]))
    for i, levels in enumerate(table.column("links").to_pylist()):
        for level, to in enumerate(levels):
            while len(g.links) <= level:
                g.links.append({})
            if to is not None:
                g.links[level][i] = to
    return table.column("id").to_numpy(), table.column("v"), g


@dataclass
class GraphIndex:
    """Graphs of all parts, one row each (``part``, ``graph``), and how they are built."""

    rows: DataFrame
    blank: Graph
    payload: str
    parts: int

    def knn(self, queries: DataFrame, k: int, ef: int = 20) -> DataFrame:
        """k nearest points of every query; queries are broadcast in blocks."""
        out = None
        for part in query_blocks(queries, QUERIES):
            found = top_k(self._search(part, k, ef), k)
            out = found if out is None else out.unionByName(found)
        return out

    def _search(self, queries: DataFrame, k: int, ef: int) -> DataFrame:
        spark, blank = queries.sparkSession, self.blank
        ship(spark)
        sent = spark.sparkContext.broadcast(collected(queries, blank.dist, self.payload))

        def run(batches):
            ids, q = sent.value
            for batch in batches:
                for data in batch.column("graph"):
                    own, _, g = unpacked(data.as_py(), blank)
                    rows = [(a, int(own[i]), float(d)) for j, a in enumerate(ids.tolist()) for d, i in g.search(q[j : j + 1], k, ef)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], FOUND)

        return self.rows.select("graph").mapInArrow(run, FOUND_SCHEMA)

    def edges(self) -> DataFrame:
        """All links: (level, src, dst)."""
        blank = self.blank
        ship(self.rows.sparkSession)

        def run(batches):
            for batch in batches:
                for data in batch.column("graph"):
                    own, _, g = unpacked(data.as_py(), blank)
                    rows = [(level, int(own[i]), int(own[j])) for level, t in enumerate(g.links) for i, to in t.items() for j in to]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["level", "src", "dst"])

        return self.rows.select("graph").mapInArrow(run, "level int, src long, dst long")

    def _part(self) -> F.Column:
        return F.pmod(F.xxhash64("id", F.lit(1)), F.lit(self.parts)).cast("int").alias("part")

    def add(self, points: DataFrame, path: str | None = None) -> GraphIndex:
        """The index with more points: each goes into the stored graph of its part. Ids must be new."""
        blank = self.blank
        ship(points.sparkSession)

        def run(key, left, right):
            new = right.sort_by("id")
            if not len(left):
                return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "graph": pa.array([packed(new.column("id").to_numpy(), new.column("v"), replace(blank, x=block(new.column("v"), blank.dist), links=[], entry=-1).build())], pa.binary())})
            if not len(new):
                return left.select(["part", "graph"])
            own, column, g = unpacked(left.column("graph")[0].as_py(), blank)
            column = pa.chunked_array([*column.chunks, *new.column("v").cast(column.type).chunks])
            n = len(own)
            g.x = block(column, blank.dist)
            g.extend(range(n, len(column)))
            g.proxy = False
            return pa.table({"part": left.column("part"), "graph": pa.array([packed(np.concatenate((own, new.column("id").to_numpy())), column.combine_chunks(), g)], pa.binary())})

        new = points.select(self._part(), F.col("id").cast("long").alias("id"), F.col(self.payload).alias("v"))
        rows = self.rows.groupBy("part").cogroup(new.groupBy("part")).applyInArrow(run, GRAPH_SCHEMA)
        return replace(self, rows=stored(rows, "graphs", path))

    def delete(self, ids: DataFrame, patch: bool = True, path: str | None = None) -> GraphIndex:
        """The index without the points of these ids."""
        blank = self.blank
        ship(ids.sparkSession)

        def run(left, right):
            if not len(left) or not len(right):
                return left.select(["part", "graph"])
            own, column, g = unpacked(left.column("graph")[0].as_py(), blank)
            keep = ~np.isin(own, right.column("id").to_numpy())
            g.remove(set(np.flatnonzero(~keep).tolist()), patch)
            place = np.cumsum(keep) - 1
            g.links = [{int(place[i]): [int(place[j]) for j in to] for i, to in t.items()} for t in g.links]
            g.entry = int(place[g.entry]) if g.entry >= 0 else -1
            return pa.table({"part": left.column("part"), "graph": pa.array([packed(own[keep], column.combine_chunks().filter(pa.array(keep)) if len(column.chunks) else column, g)], pa.binary())})

        gone = ids.select(self._part(), F.col("id").cast("long").alias("id"))
        rows = self.rows.groupBy("part").cogroup(gone.groupBy("part")).applyInArrow(run, GRAPH_SCHEMA)
        return replace(self, rows=stored(rows, "graphs", path))


GRAPH_SCHEMA = "part int, graph binary"


def graph_index(points: DataFrame, method: str = "hnsw", dist: str = "l2", payload: str = "vec", m: int | None = None, ef_construction: int | None = None, choose: int = 2, part: int = PART, path: str | None = None, most: int | None = None, most0: int | None = None, mult: float | None = None, post: int = 0, proxy: bool = False, **params) -> GraphIndex:
    """``hnsw`` (m 16, efConstruction 200) or ``sw-graph`` (NN 10, efConstruction NN), built once and stored."""
    none = np.zeros((0, 0))
    if method == "hnsw":
        blank = Graph(none, dist, m or 16, ef_construction or 200, True, choose, params=params, most=most, most0=most0, mult=mult, post=post)
    elif method == "sw-graph":
        blank = Graph(none, dist, m or 10, ef_construction or m or 10, False, 0, params=params, proxy=proxy)
    else:
        raise ValueError(f"unknown graph method {method!r}")
    ship(points.sparkSession)
    index = GraphIndex(points, blank, payload, max(1, -(-points.count() // part)))

    def run(key, table):
        table = table.sort_by("id")
        g = replace(blank, x=block(table.column("v"), blank.dist), links=[], entry=-1).build()
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "graph": pa.array([packed(table.column("id").to_numpy(), table.column("v").combine_chunks(), g)], pa.binary())})

    parted = points.select(index._part(), F.col("id").cast("long").alias("id"), F.col(payload).alias("v"))
    built = parted.repartition(index.parts, "part").groupBy("part").applyInArrow(run, GRAPH_SCHEMA)
    return replace(index, rows=stored(built, "graphs", path))


def delete_points(edges: DataFrame, points: DataFrame, gone: DataFrame, dist: str = "l2", payload: str = "vec", patch: bool = True) -> DataFrame:
    """Links without the deleted points. With ``patch`` a neighbour of a deleted point is linked to that point's nearest
    surviving neighbour, both ways."""
    ids = gone.select(F.col("id").alias("_gone"))
    left = edges.join(ids, F.col("src") == F.col("_gone"), "left_anti").join(ids, F.col("dst") == F.col("_gone"), "left_anti")
    if not patch:
        return left
    f = distance(dist)
    of = edges.join(ids, F.col("src") == F.col("_gone")).drop("_gone").join(ids, F.col("dst") == F.col("_gone"), "left_anti")
    a, b = of.select("level", F.col("src").alias("via"), F.col("dst").alias("src")), of.select("level", F.col("src").alias("via"), F.col("dst").alias("dst"))
    v = points.select("id", F.col(payload).alias("v"))
    met = a.join(b, ["level", "via"]).where("src <> dst").join(v.select(F.col("id").alias("src"), F.col("v").alias("_s")), "src").join(v.select(F.col("id").alias("dst"), F.col("v").alias("_d")), "dst")
    best = met.groupBy("level", "via", "src").agg(F.min_by("dst", F.struct(f(F.col("_d"), F.col("_s")).alias("d"), F.col("dst"))).alias("dst")).select("level", "src", "dst")
    return left.select("level", "src", "dst").unionByName(best).unionByName(best.select("level", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
