"""The index API: init, add points, create the index, query, save and load.

Points and queries may be DataFrames (id, payload) or Python data; results are DataFrames, with Python arrays for
single queries. Parameters are checked by name, and query-time parameters belong to the index object alone. What
``createIndex`` makes (leaves, prefixes, graphs, postings) is written once; queries, and an index that is loaded
again, read it.

Parameters that only steer threads, copies or the layout of memory (``LAYOUT``) are accepted and change no result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels, vectors
from ..functions.distances import distance, space
from ..operators import graphs, inverted, knn, vptree
from ..storage import stored

#: Parameters of each method: index time and query time, with their defaults.
METHODS: dict[str, tuple[dict, dict]] = {
    "brute_force": ({"copyMem": False, "multiThread": False, "threadQty": 0}, {}),
    "simple_invindx": ({}, {"dummyParam": -1}),
    "napp": ({"numPivot": 512, "numPivotIndex": 32, "chunkIndexSize": 65536, "indexThreadQty": 0, "hashTrickDim": 0, "disablePivotIndex": False, "recreatePoints": False}, {"numPivotSearch": 2, "numPrefixSearch": None, "useSort": False, "skipChecking": False, "invProcAlg": "scan", "dbScanFrac": 0.05, "knnAmp": 0}),
    "vptree": ({"bucketSize": 50, "chunkBucket": True, "selectPivotAttempts": 5, "tuneK": None, "tuneR": None, "desiredRecall": None, "tuneQty": 5000, "minExp": 1, "maxExp": 1}, {"alphaLeft": 1.0, "alphaRight": 1.0, "expLeft": 1.0, "expRight": 1.0, "maxLeavesToVisit": None}),
    "sw-graph": ({"NN": 10, "efConstruction": None, "indexThreadQty": 0, "useProxyDist": False}, {"efSearch": None, "algoType": "old"}),
    "hnsw": ({"M": 16, "efConstruction": 200, "maxM": None, "maxM0": None, "mult": None, "delaunay_type": 2, "post": 0, "skip_optimized_index": 0, "indexThreadQty": 0, "searchMethod": 0}, {"ef": 20, "algoType": "hybrid"}),
}
#: Parameters without an effect on results, of any method.
LAYOUT = ("copyMem", "multiThread", "threadQty", "indexThreadQty", "chunkIndexSize", "chunkBucket", "recreatePoints", "skip_optimized_index", "searchMethod", "dummyParam", "invProcAlg", "algoType")
#: Values that such a parameter may have.
VALUES = {"invProcAlg": ("scan", "map", "merge", "wand", "pqueue"), "algoType": ("old", "v1merge", "hybrid"), "searchMethod": (0, 1, 2, 3, 4), "delaunay_type": (0, 1, 2, 3), "post": (0, 1, 2)}
#: Other names of methods and parameters.
SYNONYMS = {"seq_search": "brute_force", "pivot_neighb_invindx": "napp", "small_world_rand": "sw-graph"}
SAME = {"numPrefix": "numPivotIndex", "minTimes": "numPivotSearch", "efSearch": "ef"}
PAYLOADS = {"DENSE_VECTOR": ("dense", "distribution", "rank"), "DENSE_UINT8_VECTOR": ("dense_uint8",), "SPARSE_VECTOR": ("sparse",), "OBJECT_AS_STRING": ("string", "bits", "set", "signature")}


def parameters(given: dict | list | None) -> dict:
    """A dictionary, a list of ``name=value``, or nothing; a name given twice is an error."""
    if given is None:
        return {}
    if isinstance(given, dict):
        return dict(given)
    out: dict = {}
    for item in given:
        name, _, value = item.partition("=")
        if name in out:
            raise ValueError(f"parameter {name!r} is given twice")
        try:
            out[name] = json.loads(value)
        except ValueError:
            out[name] = value
    return out


def resolved(given: dict | list | None, known: dict) -> dict:
    """Known parameters with their defaults; synonyms are one parameter, and unknown names are errors."""
    out, named = dict(known), set()
    for name, value in parameters(given).items():
        own = name if name in known else SAME.get(name, name)
        if own not in known:
            raise ValueError(f"unknown parameter {name!r}; known: {', '.join(known) or 'none'}")
        if own in named:
            raise ValueError(f"parameter {own!r} is given twice, by synonyms")
        if own in VALUES and value not in VALUES[own]:
            raise ValueError(f"parameter {own!r} is one of {VALUES[own]}")
        named.add(own)
        out[own] = value
    return out


@dataclass
class Index:
    """Made by ``init``."""

    spark: SparkSession
    space: str
    space_params: dict
    method: str
    data_type: str
    dtype: str
    payload: str = "vec"
    points: DataFrame | None = None
    index_params: dict | None = None
    query_params: dict = field(default_factory=dict)
    built: object = None
    pending: list = field(default_factory=list)
    counted: int = 0

    def addDataPoint(self, id: int, data) -> int:  # noqa: A002, N802
        self.pending.append((int(id), data))
        return len(self) - 1

    def addDataPointBatch(self, data, ids=None) -> int:  # noqa: N802
        """Adds a DataFrame (id, payload), a sequence of objects, or a sparse matrix (rows as sparse vectors); ids default
        to the row number."""
        if isinstance(data, DataFrame):
            new = data.select("id", self.payload)
            n = new.count()
            self.points = new if self.points is None else self.points.unionByName(new)
            self.counted += n
            return n
        start = len(self)
        rows = sparse_rows(data) if hasattr(data, "indptr") else list(data)
        self.pending += list(zip(map(int, ids) if ids is not None else range(start, start + len(rows)), rows, strict=True))
        return len(rows)

    def _schema(self) -> str:
        kind = space(self.space).kind
        own = {"sparse": "array<struct<dim:int,val:double>>", "string": "string", "bits": "array<int>", "set": "array<int>", "dense_uint8": "array<int>", "signature": "array<struct<centroid:array<double>,weight:double>>"}.get(kind, "array<double>")
        return f"id long, `{self.payload}` {own}"

    def _plain(self, x):
        if isinstance(x, np.ndarray):
            return x.tolist()
        if space(self.space).kind == "sparse":
            return [(int(a), float(b)) for a, b in sorted(x)]
        return x

    def _flush(self) -> DataFrame:
        if self.pending:
            new = self.spark.createDataFrame([(i, self._plain(x)) for i, x in self.pending], self._schema())
            self.points = new if self.points is None else self.points.unionByName(new)
            self.counted += len(self.pending)
            self.pending = []
        if self.points is None:
            self.points = self.spark.createDataFrame([], self._schema())
        return self.points

    def createIndex(self, index_params=None, print_progress: bool = False, path: str | None = None) -> None:  # noqa: N802
        """Builds the index and writes it, under ``path`` or in the shared folder."""
        p = resolved(index_params, METHODS[self.method][0])
        points, name, own = self._flush(), self.space, self.space_params
        self.index_params = p
        self.setQueryTimeParams(None)
        if self.method == "napp":
            self.built = self._prefixed(points, p, path)
        elif self.method == "vptree":
            self.built = vptree.VPTree.build(points, name, self.payload, p["bucketSize"], attempts=p["selectPivotAttempts"], path=path, **own)
            if p["desiredRecall"] is not None:
                self._tune(points, p)
        elif self.method == "hnsw":
            self.built = graphs.graph_index(points, "hnsw", name, self.payload, p["M"], p["efConstruction"], p["delaunay_type"], path=path, most=p["maxM"], most0=p["maxM0"], mult=p["mult"], post=p["post"], **own)
        elif self.method == "sw-graph":
            self.built = graphs.graph_index(points, "sw-graph", name, self.payload, p["NN"], p["efConstruction"], path=path, proxy=p["useProxyDist"], **own)
        elif self.method == "simple_invindx":
            inverted.product_space(name)
            self.built = stored(inverted.postings(points, self.payload), "postings", path)
        else:
            self.built = points

    def _hashed(self, df: DataFrame) -> DataFrame:
        """Sparse vectors folded to ``hashTrickDim`` numbers, which meet the pivots then, as column ``_h``."""
        return df.withColumn("_h", vectors.hash_trick(F.col(self.payload), int(self.index_params["hashTrickDim"])))

    def _index_space(self) -> str:
        return self.space.split("_sparse")[0] if self.index_params["hashTrickDim"] else self.space

    def _prefixed(self, points: DataFrame, p: dict, path: str | None) -> tuple[DataFrame, DataFrame]:
        """Pivots, and points with their nearest pivots, both stored."""
        if p["hashTrickDim"] and space(self.space).kind != "sparse":
            raise ValueError("hashTrickDim folds sparse vectors")
        pivots = stored(inverted.choose_pivots(points, p["numPivot"], self.payload), "pivots", path)
        rows, asked, column = points.select("id", self.payload), pivots, None
        if p["hashTrickDim"]:
            rows, asked, column = self._hashed(rows), self._hashed(pivots).select("pivot_id", F.col("_h").alias(self.payload)), "_h"
        return pivots, stored(inverted.with_prefix(rows, asked, self._index_space(), min(p["numPivotIndex"], p["numPivot"]), self.payload, indexed=column, **self.space_params), "prefixes", path)

    def _tune(self, points: DataFrame, p: dict) -> None:
        """Sets the pruner that needs the fewest distances for the desired recall, on some of the points as queries."""
        q = points.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(min(int(p["tuneQty"]), 50)).select(F.col("id").alias("query_id"), self.payload)
        exps = tuple(float(e) for e in range(int(p["minExp"]), int(p["maxExp"]) + 1))
        if (p["tuneK"] is None) == (p["tuneR"] is None):
            raise ValueError("tune for one of tuneK and tuneR")
        if p["tuneK"] is not None:
            k = int(p["tuneK"])
            gold = knn.search(points, q, 10 * k, self.space, self.payload, self.space_params)
            best = vptree.tune(self.built, q, gold, k, float(p["desiredRecall"]), exps=exps)[0]
        else:
            gold = knn.search_range(points, q, float(p["tuneR"]), self.space, self.payload, self.space_params)
            best = vptree.tune(self.built, q, gold, 0, float(p["desiredRecall"]), exps=exps, radius=float(p["tuneR"]))[0]
        self.query_params |= {"alphaLeft": best.alpha_left, "alphaRight": best.alpha_right, "expLeft": best.exp_left, "expRight": best.exp_right}

    def addBatch(self, points: DataFrame) -> None:  # noqa: N802
        """Adds points (id, payload) to the built graphs, or to the stored leaves or prefixes by building them anew."""
        self._built()
        self.addDataPointBatch(points)
        if self.method in ("hnsw", "sw-graph"):
            self.built = self.built.add(points, None)
        else:
            kept = self.query_params
            self.createIndex(self.index_params)
            self.query_params = kept

    def deleteBatch(self, ids: DataFrame, patch: bool = True) -> None:  # noqa: N802
        """Takes the points with these ids (a DataFrame with ``id``) out of the index; graphs are patched where they are."""
        self._built()
        self.points = self._flush().join(ids.select("id"), "id", "left_anti")
        self.counted = self.points.count()
        if self.method in ("hnsw", "sw-graph"):
            self.built = self.built.delete(ids, patch)
        else:
            kept = self.query_params
            self.createIndex(self.index_params)
            self.query_params = kept

    def _built(self) -> None:
        if self.built is None:
            raise RuntimeError("create or load an index before querying")

    def setQueryTimeParams(self, params=None) -> None:  # noqa: N802
        """Sets the parameters of later queries; none resets them."""
        self.query_params = resolved(params, METHODS[self.method][1])

    def _queries(self, queries) -> DataFrame:
        if isinstance(queries, DataFrame):
            return queries
        rows = [(i, self._plain(x)) for i, x in enumerate(queries)]
        return self.spark.createDataFrame(rows, self._schema()).withColumnRenamed("id", "query_id")

    def _napp(self, q: DataFrame, **more) -> DataFrame:
        (pivots, rows), p, i = self.built, self.query_params, self.index_params
        folded = {}
        if i["hashTrickDim"]:
            q = self._hashed(q)
            folded = {"index_space": self._index_space(), "index_pivots": self._hashed(pivots).select("pivot_id", F.col("_h").alias(self.payload)), "query_index": "_h"}
        prefix = min(p["numPrefixSearch"] or i["numPivotIndex"], i["numPivot"])
        return inverted.shared_scan(rows, q, pivots, self.space, self.payload, p["numPivotSearch"], prefix, **folded, **more, **self.space_params)

    def knnQueryBatch(self, queries, k: int = 10, num_threads: int = 0) -> DataFrame:  # noqa: N802
        """(query_id, rank, id, dist) of every query."""
        self._built()
        q, p, name = self._queries(queries), self.query_params, self.space
        if self.method == "napp":
            if self.index_params["disablePivotIndex"]:  # every point is a candidate
                return knn.search(self.points, q, k, name, self.payload, self.space_params)
            budget = None
            if p["useSort"]:
                budget = p["knnAmp"] * k if p["knnAmp"] else max(k, int(p["dbScanFrac"] * self.counted))
            return self._napp(q, k=k, budget=budget, by_shared=p["skipChecking"])
        if self.method == "vptree":
            return self.built.knn(q, k, self._pruner(), p["maxLeavesToVisit"])
        if self.method in ("hnsw", "sw-graph"):
            return self.built.knn(q, k, p.get("ef") or p.get("efSearch") or self.index_params.get("NN", 20))
        if self.method == "simple_invindx":
            return inverted.inverted_knn(self.built, q, k, self.payload, name)
        return knn.search(self.points, q, k, name, self.payload, self.space_params)

    def _pruner(self) -> vptree.Pruner:
        p = self.query_params
        return vptree.Pruner(p["alphaLeft"], p["alphaRight"], p["expLeft"], p["expRight"])

    def knnQuery(self, vector, k: int = 10) -> tuple[np.ndarray, np.ndarray]:  # noqa: N802
        rows = self.knnQueryBatch([vector], k).orderBy("rank").collect()
        return np.array([r["id"] for r in rows], np.int64), np.array([r["dist"] for r in rows])

    def rangeQueryBatch(self, queries, radius: float) -> DataFrame:  # noqa: N802
        """(query_id, id, dist) within the radius."""
        self._built()
        q = self._queries(queries)
        if self.method == "vptree":
            return self.built.range_search(q, radius, self._pruner())
        if self.method == "napp":
            return self._napp(q, radius=radius)
        if self.method == "brute_force":
            return knn.search_range(self.points, q, radius, self.space, self.payload, self.space_params)
        raise RuntimeError(f"method {self.method!r} has no range search")

    def getDistance(self, a: int, b: int) -> float:  # noqa: N802
        """The distance of the points with these ids."""
        f = distance(self.space, **self.space_params)
        v = self._flush().select("id", self.payload)
        x, y = v.where(F.col("id") == a).select(F.col(self.payload).alias("x")), v.where(F.col("id") == b).select(F.col(self.payload).alias("y"))
        return x.join(y, how="cross").select(f(F.col("x"), F.col("y")).alias("d")).first()[0]

    def saveIndex(self, filename: str, save_data: bool = True) -> None:  # noqa: N802
        """Points and what was built, as Parquet, and a manifest with a checksum of the points."""
        points = self._flush()
        if save_data:
            points.write.mode("overwrite").parquet(f"{filename}/points")
        if self.method == "vptree" and self.built:
            self.built.save(filename)
        elif self.method in ("hnsw", "sw-graph") and self.built:
            stored(self.built.rows, "graphs", filename)
        elif self.method == "napp" and self.built:
            for df, name in zip(self.built, ("pivots", "prefixes"), strict=True):
                stored(df, name, filename)
        elif self.method == "simple_invindx" and self.built is not None:
            stored(self.built, "postings", filename)
        about = {"space": self.space, "space_params": self.space_params, "method": self.method, "index_params": self.index_params, "query_params": self.query_params, "data_type": self.data_type, "dtype": self.dtype, "payload": self.payload, "check": _check(points), "count": self.counted, "parts": getattr(self.built, "parts", None)}
        self.spark.createDataFrame([(json.dumps(about),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{filename}/manifest")

    def loadIndex(self, filename: str, load_data: bool = True) -> None:  # noqa: N802
        """Loads what ``saveIndex`` wrote, and builds nothing; other data than that of the manifest is an error. Query
        parameters are reset (to the tuned ones, where the index was tuned)."""
        about = json.loads(self.spark.read.text(f"{filename}/manifest").first()[0])
        if (about["space"], about["method"]) != (self.space, self.method):
            raise ValueError("the saved index is of another space or method")
        self.points = self.spark.read.parquet(f"{filename}/points") if load_data else self._flush()
        if _check(self.points) != about["check"]:
            raise ValueError("the data changed since the index was saved")
        self.counted, p = about["count"], about["index_params"]
        read = lambda name: self.spark.read.parquet(f"{filename}/{name}")
        self.index_params = p
        if p is None:
            return
        if self.method == "vptree":
            self.built = vptree.VPTree.load(self.spark, filename, self.space, self.payload, **self.space_params)
        elif self.method == "hnsw":
            blank = graphs.Graph(np.zeros((0, 0)), self.space, p["M"], p["efConstruction"], True, p["delaunay_type"], params=self.space_params, most=p["maxM"], most0=p["maxM0"], mult=p["mult"], post=p["post"])
            self.built = graphs.GraphIndex(read("graphs"), blank, self.payload, about["parts"])
        elif self.method == "sw-graph":
            blank = graphs.Graph(np.zeros((0, 0)), self.space, p["NN"], p["efConstruction"] or p["NN"], False, 0, params=self.space_params, proxy=p["useProxyDist"])
            self.built = graphs.GraphIndex(read("graphs"), blank, self.payload, about["parts"])
        elif self.method == "napp":
            self.built = (read("pivots"), read("prefixes"))
        else:
            self.built = read("postings") if self.method == "simple_invindx" else self.points
        self.setQueryTimeParams(None)
        if p.get("desiredRecall") is not None:
            self.query_params = about["query_params"]

    def __len__(self) -> int:
        return self.counted + len(self.pending)

    def __getitem__(self, position: int):
        rows = self._flush().orderBy("id").offset(position).limit(1).select(self.payload).collect()
        if not rows:
            raise IndexError(position)
        return rows[0][0]

    def __repr__(self) -> str:
        return f"<Index method={self.method!r} space={self.space!r} data_type={self.data_type} dtype={self.dtype}>"


def sparse_rows(matrix) -> list[list[tuple[int, float]]]:
    """Rows of a matrix in compressed sparse row form (``indptr``, ``indices``, ``data``) as sparse vectors."""
    return [[(int(d), float(v)) for d, v in sorted(zip(matrix.indices[a:z], matrix.data[a:z], strict=True))] for a, z in zip(matrix.indptr[:-1], matrix.indptr[1:], strict=True)]


def _check(points: DataFrame) -> list[int]:
    return list(points.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*points.columns)), F.lit(0))).first())


def init(spark: SparkSession, space_name: str = "cosinesimil", space_params=None, method: str = "hnsw", data_type: str = "DENSE_VECTOR", dtype: str = "FLOAT", payload: str = "vec") -> Index:
    """An empty index; the data type must fit the space."""
    s, method = space(space_name), SYNONYMS.get(method, method)
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    if s.kind not in PAYLOADS.get(data_type, ()):
        raise ValueError(f"space {space_name!r} takes no {data_type}")
    given = parameters(space_params)
    distance(space_name, **given)
    if method in ("hnsw", "sw-graph", "vptree") and space_name not in kernels.KERNELS:
        raise ValueError(f"method {method!r} takes the spaces {', '.join(kernels.KERNELS)}")
    return Index(spark, space_name, given, method, data_type, "INT" if s.integer else dtype, payload)


# free functions over an index object, by their older names


def setDataPoints(index: Index, data, ids=None) -> int:  # noqa: N802
    return index.addDataPointBatch(data, ids)


def addDataPoint(index: Index, id: int, data) -> int:  # noqa: A002, N802
    return index.addDataPoint(id, data)


def addDataPointBatch(index: Index, ids, data) -> int:  # noqa: N802
    return index.addDataPointBatch(data, ids)


def createIndex(index: Index, params=None) -> None:  # noqa: N802
    index.createIndex(params)


def setQueryTimeParams(index: Index, params=None) -> None:  # noqa: N802
    index.setQueryTimeParams(params)


def knnQuery(index: Index, k: int, data) -> list[int]:  # noqa: N802
    """Ids only, nearest first."""
    return index.knnQuery(data, k)[0].tolist()


def knnQueryBatch(index: Index, num_threads: int, k: int, queries) -> list[list[int]]:  # noqa: N802
    """Ids of each query in order."""
    rows = index.knnQueryBatch(queries, k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda r: r["id"]).alias("ids")).collect()
    found = {r["query_id"]: r["ids"] for r in rows}
    return [found.get(i, []) for i in range(len(queries))]


def getDataPoint(index: Index, position: int):  # noqa: N802
    return index[position]


def getDataPointQty(index: Index) -> int:  # noqa: N802
    return len(index)


def saveIndex(index: Index, filename: str) -> None:  # noqa: N802
    index.saveIndex(filename)


def loadIndex(index: Index, filename: str) -> None:  # noqa: N802
    index.loadIndex(filename)


def freeIndex(index: Index) -> None:  # noqa: N802
    """Lets go of points and of what was built; stored tables stay until the shared folder is cleaned."""
    index.points, index.built, index.pending, index.counted = None, None, [], 0
