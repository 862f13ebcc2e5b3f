"""Index API, readers, saving, streams, pruning."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity.operators import evaluation as ev
from vicinity.operators.graphs import delete_points, graph_index
from vicinity.operators.knn import knn, range_search
from vicinity.operators.vptree import Pruner, VPTree, tune
from vicinity.plans.session import init, parameters
from vicinity.sources import text
from vicinity.streaming.search import answer_stream, append_points, stored_points


@pytest.fixture(scope="module")
def data():
    return np.random.default_rng(23).standard_normal((400, 10))


@pytest.fixture(scope="module")
def points(spark, data):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "id long, vec array<double>").cache()


def exact(data, q, k):
    return np.argsort(((data - q) ** 2).sum(1), kind="stable")[:k]


@pytest.mark.parametrize(("method", "hits"), [("brute_force", 10), ("vptree", 10), ("hnsw", 9), ("sw-graph", 8), ("napp", 8)])
def test_index_methods(spark, data, method, hits):
    index = init(spark, "l2", method=method)
    index.addDataPointBatch(data)
    index.createIndex({"numPivot": 64, "numPivotIndex": 24} if method == "napp" else None)
    if method in ("hnsw", "sw-graph"):
        index.setQueryTimeParams({"efSearch": 60})
    ids, dists = index.knnQuery(data[3], k=10)
    assert len(set(ids.tolist()) & set(exact(data, data[3], 10).tolist())) >= hits
    assert (np.diff(dists) >= 0).all()
    assert len(index) == 400


def test_ids_save_and_load(spark, data, tmp_path):
    index = init(spark, "l2", method="brute_force")
    index.addDataPointBatch(data[:50], ids=[i * i for i in range(50)])
    index.createIndex()
    index.saveIndex(str(tmp_path / "index"))
    again = init(spark, "l2", method="brute_force")
    again.loadIndex(str(tmp_path / "index"))
    assert again.knnQuery(data[7], k=1)[0].tolist() == [49]
    assert index.getDistance(4, 9) == pytest.approx(np.linalg.norm(data[2] - data[3]))
    other = init(spark, "l2", method="brute_force")
    other.addDataPointBatch(data[:49])
    with pytest.raises(ValueError):
        other.loadIndex(str(tmp_path / "index"), load_data=False)


def test_errors(spark, data):
    with pytest.raises(ValueError):
        init(spark, "l2", data_type="SPARSE_VECTOR")
    with pytest.raises(ValueError):
        init(spark, "l2", method="nope")
    index = init(spark, "l2", method="hnsw")
    with pytest.raises(RuntimeError):
        index.knnQueryBatch(data[:1])
    with pytest.raises(ValueError):
        index.createIndex({"N": 1})
    with pytest.raises(ValueError):
        index.setQueryTimeParams({"ef": 1, "efSearch": 2})
    with pytest.raises(ValueError):
        parameters(["a=1", "a=2"])


def test_strings_and_sparse(spark):
    index = init(spark, "leven", method="brute_force", data_type="OBJECT_AS_STRING")
    index.addDataPointBatch(["atcg", "atcc", "gggg"])
    index.createIndex()
    assert index.knnQuery("atcg", k=2)[0].tolist() == [0, 1]
    sparse = init(spark, "negdotprod_sparse_fast", method="simple_invindx", data_type="SPARSE_VECTOR")
    sparse.addDataPointBatch([[(0, 1.0), (3, 2.0)], [(3, 5.0)], [(7, 1.0)]])
    sparse.createIndex()
    assert sparse.knnQuery([(3, 1.0)], k=5)[0].tolist() == [1, 0]
    assert sparse.knnQuery([(99, 1.0)], k=5)[0].tolist() == []


def test_range_equals_filter(points, data):
    q = points.where("id < 5").select(F.col("id").alias("query_id"), "vec")
    got = {(r.query_id, r.id) for r in range_search(points, q, 3.0).collect()}
    assert got == {(i, j) for i in range(5) for j in range(400) if np.linalg.norm(data[i] - data[j]) <= 3.0}
    assert got == {(r.query_id, r.id) for r in VPTree.build(points, bucket=20).range_search(q, 3.0).collect()}


def test_vptree_prunes_and_tunes(points):
    q = points.where("id < 10").select(F.col("id").alias("query_id"), "vec")
    index, gold = VPTree.build(points, bucket=10), ev.gold_standard(points, q, 5)
    pruner, recall, n = tune(index, q, gold, 5, 0.8, rounds=2)
    assert recall >= 0.8
    assert n <= index.distance_computations(q, 5, Pruner()).agg(F.avg("n")).first()[0]


def test_approximate_never_beats_exact(points):
    q = points.where("id < 10").select(F.col("id").alias("query_id"), "vec")
    gold, found = ev.gold_standard(points, q, 5), graph_index(points, "hnsw", part=150).knn(q, 5)
    assert ev.recall(gold, found, 5).agg(F.avg("recall")).first()[0] >= 0.9
    worst = found.groupBy("query_id").agg(F.max("dist").alias("a")).join(knn(points, q, 5).groupBy("query_id").agg(F.max("dist").alias("b")), "query_id")
    assert worst.where("a < b - 1e-9").count() == 0


def test_graph_deletion(points):
    index = graph_index(points, "sw-graph")
    edges = index.edges()
    gone = points.where("id % 7 = 0").select("id")
    left = delete_points(edges, points, gone)
    assert left.join(gone, (F.col("src") == F.col("id")) | (F.col("dst") == F.col("id"))).count() == 0
    assert left.count() >= delete_points(edges, points, gone, patch=False).count()


def plans(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("method", "space_name", "params"), [("vptree", "l2", {"bucketSize": 20}), ("hnsw", "l2", {"M": 8, "efConstruction": 40, "maxM0": 12, "mult": 0.5, "delaunay_type": 3, "post": 1}), ("sw-graph", "kldivfast", {"NN": 8, "efConstruction": 40, "useProxyDist": True}), ("napp", "l2", {"numPivot": 40, "numPivotIndex": 16}), ("brute_force", "l2", {})])
def test_a_loaded_index_is_not_built_again(spark, data, tmp_path, monkeypatch, method, space_name, params):
    rows = np.abs(data) + 0.01 if space_name == "kldivfast" else data
    index = init(spark, space_name, method=method)
    index.addDataPointBatch(rows)
    index.createIndex(params)
    queries = spark.createDataFrame([(i, rows[i].tolist()) for i in range(8)], "query_id long, vec array<double>")
    want = sorted((r.query_id, r.rank, r.id, round(r.dist, 9)) for r in index.knnQueryBatch(queries, 5).collect())
    index.saveIndex(str(tmp_path / "index"))
    for name in ("build", "extend"):
        monkeypatch.setattr(f"vicinity.operators.graphs.Graph.{name}", None)
    monkeypatch.setattr("vicinity.operators.vptree.build_tree", None)
    monkeypatch.setattr("vicinity.operators.inverted.with_prefix", None)
    again = init(spark, space_name, method=method)
    again.loadIndex(str(tmp_path / "index"))
    found = again.knnQueryBatch(queries, 5)
    assert sorted((r.query_id, r.rank, r.id, round(r.dist, 9)) for r in found.collect()) == want
    assert "FlatMapGroupsInArrow" not in plans(found) and len(again) == 400


def test_only_reached_leaves_are_read(spark, tmp_path):
    line = spark.range(4000).select("id", F.array(F.col("id").cast("double"), F.lit(0.0)).alias("vec"))
    index = VPTree.build(line, bucket=50, path=str(tmp_path))
    near = spark.createDataFrame([(7, [1000.2, 0.0])], "query_id long, vec array<double>")
    assert [r.id for r in index.knn(near, 3).orderBy("rank").collect()] == [1000, 1001, 999]
    assert index.distance_computations(near, 3).first().n < 400
    assert "leaf" in plans(index.range_search(near, 5.0)).split("PushedFilters")[1][:200]


@pytest.mark.parametrize("method", ["hnsw", "sw-graph", "vptree", "napp"])
def test_add_and_delete(spark, data, points, method):
    index = init(spark, "l2", method=method)
    index.addDataPointBatch(points.where("id < 300"))
    index.createIndex({"numPivot": 32, "numPivotIndex": 16} if method == "napp" else None)
    index.addBatch(points.where("id >= 300"))
    index.deleteBatch(points.where("id % 4 = 1").select("id"))
    assert len(index) == 300
    if method in ("hnsw", "sw-graph"):
        index.setQueryTimeParams({"efSearch": 80})
    left = np.array([i for i in range(400) if i % 4 != 1])
    hits = 0
    for i in (5, 301, 399):
        found = index.knnQuery(data[i], k=10)[0].tolist()
        assert not [j for j in found if j % 4 == 1]
        hits += len(set(found) & set(left[exact(data[left], data[i], 10)].tolist()))
    assert hits >= 24


def test_inverted_file_answers_in_its_space(spark):
    points = [[(0, 2.0), (1, 1.0)], [(0, 1.0)], [(5, 1.0)]]
    for name, dists in (("cosinesimil_sparse", [0.0, 1 - 2 / 5**0.5]), ("negdotprod_sparse_fast", [-2.0, -1.0])):
        index = init(spark, name, method="simple_invindx", data_type="SPARSE_VECTOR")
        index.addDataPointBatch(points)
        index.createIndex()
        ids, got = index.knnQuery([(0, 1.0)], k=5)
        assert ids.tolist() == ([1, 0] if name.startswith("cos") else [0, 1]) and got == pytest.approx(dists)
    other = init(spark, "l1_sparse", method="simple_invindx", data_type="SPARSE_VECTOR")
    other.addDataPointBatch(points)
    with pytest.raises(ValueError, match="inner products"):
        other.createIndex()


def test_folded_pivots_and_budget(spark):
    r = random.Random(4)
    rows = [sorted({(r.randint(0, 300), 1.0 + r.random()) for _ in range(20)}) for _ in range(200)]
    rows = [list(dict(x).items()) for x in rows]
    index = init(spark, "cosinesimil_sparse", method="napp", data_type="SPARSE_VECTOR")
    index.addDataPointBatch(rows)
    with pytest.raises(ValueError, match="fewer pivots"):
        index.createIndex({"numPivot": 200})
    index.createIndex({"numPivot": 50, "numPivotIndex": 20, "hashTrickDim": 64})
    assert index.knnQuery(rows[11], k=1)[0].tolist() == [11]
    index.setQueryTimeParams({"useSort": True, "knnAmp": 3, "numPivotSearch": 1})
    assert index.knnQuery(rows[11], k=1)[0].tolist() == [11]
    index.setQueryTimeParams({"skipChecking": True})
    assert index.knnQuery(rows[11], k=1)[1].tolist() == [-20.0]


def test_tuned_index(spark, points, tmp_path):
    index = init(spark, "l2", method="vptree")
    index.addDataPointBatch(points)
    index.createIndex({"tuneK": 3, "desiredRecall": 0.8, "tuneQty": 8, "bucketSize": 20})
    assert index.query_params["alphaLeft"] >= 1.0
    index.saveIndex(str(tmp_path / "t"))
    again = init(spark, "l2", method="vptree")
    again.loadIndex(str(tmp_path / "t"))
    assert again.query_params == index.query_params
    with pytest.raises(ValueError):
        index.createIndex({"desiredRecall": 0.8})


def test_free_functions_and_sparse_matrices(spark, data):
    from types import SimpleNamespace

    from vicinity.plans import session

    index = init(spark, "l2", method="brute_force")
    session.addDataPointBatch(index, list(range(20)), data[:20])
    session.createIndex(index)
    assert session.knnQuery(index, 1, data[4]) == [4] and session.knnQueryBatch(index, 1, 1, data[:3]) == [[0], [1], [2]]
    assert session.getDataPointQty(index) == 20 and session.getDataPoint(index, 3) == pytest.approx(data[3].tolist())
    session.freeIndex(index)
    assert len(index) == 0
    csr = SimpleNamespace(indptr=np.array([0, 2, 2, 3]), indices=np.array([3, 0, 7]), data=np.array([2.0, 1.0, 5.0]))
    assert session.sparse_rows(csr) == [[(0, 1.0), (3, 2.0)], [], [(7, 5.0)]]
    with pytest.raises(ValueError):
        init(spark, "l2", method="hnsw").createIndex({"post": 9})


def test_infinite_and_undefined_distances_stay(spark):
    p = spark.createDataFrame([(0, [0.0]), (1, [float("inf")]), (2, [float("nan")])], "id long, vec array<double>")
    q = spark.createDataFrame([(0, [0.0])], "query_id long, vec array<double>")
    from vicinity.operators.knn import knn_blocks

    assert [r.id for r in knn_blocks(p, q, 5, "l1").orderBy("rank").collect()] == [r.id for r in knn(p, q, 5, "l1").orderBy("rank").collect()] == [0, 1, 2]


def test_tools(spark, points):
    from vicinity.plans.tools import distance_rates, tune_vptree

    got = tune_vptree(points, "l2", None, 0.9, radius=3.0, queries=8, bucket=20)
    assert got["recall"] >= 0.9 and got["impr_dist_comp"] >= 1
    assert {r.space for r in distance_rates(spark, ["l2", "l1"], 8, 500, 10).collect()} == {"l2", "l1"}


def test_bootstrap_needs_enough_points(points):
    with pytest.raises(ValueError):
        ev.bootstrap_split(points, 10, 100)


def test_text_round_trips(spark, tmp_path):
    dense = spark.createDataFrame([(0, 5, [0.1, -2.0]), (1, None, [1e-9, 3.5])], "id long, label int, vec array<double>").coalesce(1)
    text.write_dense(dense, str(tmp_path / "dense"))
    assert [(r.id, r.label, r.vec) for r in text.read_dense(spark, str(tmp_path / "dense")).orderBy("id").collect()] == [(0, 5, [0.1, -2.0]), (1, None, [1e-9, 3.5])]
    sparse = spark.createDataFrame([(0, [(2, 0.5), (9, 1.0)])], "id long, vec array<struct<dim:int,val:double>>")
    text.write_sparse(sparse, str(tmp_path / "sparse"))
    assert [tuple(e) for e in text.read_sparse(spark, str(tmp_path / "sparse")).first().vec] == [(2, 0.5), (9, 1.0)]


def _lines(tmp_path, name, *lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_readers(spark, tmp_path):
    assert text.read_bits(spark, _lines(tmp_path, "bits", "0 1 1", "label:3 1 0 0")).orderBy("id").first().words == [6]
    assert text.read_sets(spark, _lines(tmp_path, "sets", "3 1 2")).first()["items"] == [1, 2, 3]
    got = text.read_strings(spark, _lines(tmp_path, "strings", "label:4 acgt x")).first()
    assert (got.label, got.s) == (4, "acgt x")
    assert text.read_words(spark, _lines(tmp_path, "words", "the 1 2")).first().extern_id == "the"
    assert text.read_sift(spark, _lines(tmp_path, "sift", " ".join(["2"] * 128))).first().sqnorm == 512
    sig = text.read_signatures(spark, _lines(tmp_path, "sig", "2 1", "", "1 0.5", "2 0.5", "", "3 1.0"))
    assert [len(r.clusters) for r in sig.orderBy("id").collect()] == [2, 1]
    for read, line in ((text.read_bits, "0 2"), (text.read_sparse, "1 1 1 2"), (text.read_strings, "no label"), (text.read_sift, "1 2")):
        with pytest.raises(Exception, match="line"):
            read(spark, _lines(tmp_path, f"bad{random.random()}", line)).collect()


def test_numbering_follows_lines(spark, tmp_path):
    path = _lines(tmp_path, "many", *(f"{i} 0" for i in range(1000)))
    assert [(r.id, r.vec[0]) for r in text.read_dense(spark, path).orderBy("id").collect()] == [(i, float(i)) for i in range(1000)]
    assert text.read_dense(spark, path, limit=7).count() == 7


def test_stream(spark, points, tmp_path):
    source = str(tmp_path / "source")
    points.where("id < 50").repartition(2).write.parquet(source)
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = append_points(stream, str(tmp_path / "stored"), str(tmp_path / "c1"))
    query.processAllAvailable()
    query.stop()
    kept = stored_points(spark, str(tmp_path / "stored"), points.where("id = 3").select("id"))
    assert kept.count() == 49
    asked = str(tmp_path / "asked")
    points.where("id < 4").select(F.col("id").alias("query_id"), "vec").write.parquet(asked)
    s = spark.readStream.schema("query_id long, vec array<double>").parquet(asked)
    answers = answer_stream(s, kept, 2, str(tmp_path / "answers"), str(tmp_path / "c2"))
    answers.processAllAvailable()
    answers.stop()
    assert spark.read.parquet(str(tmp_path / "answers")).where("rank = 1 and query_id <> 3").where("dist > 1e-9").count() == 0


@pytest.mark.parametrize("method", ["vptree", "hnsw", "sw-graph"])
@pytest.mark.parametrize(("name", "kind"), [("leven", "string"), ("jsmetrfast", "array<double>"), ("bit_hamming", "array<int>"), ("cosinesimil_sparse", "array<struct<dim:int,val:double>>")])
def test_methods_over_other_payloads(spark, method, name, kind):
    """Non-dense spaces: exact for metrics by partitions, nearly so by graphs."""
    from .test_distances import _payloads
    from vicinity.functions.distances import space

    r = random.Random(9)
    rows = [(i, _payloads(space(name).kind, r)) for i in range(120)]
    p = spark.createDataFrame(rows, f"id long, vec {kind}")
    q = p.where("id < 5").select(F.col("id").alias("query_id"), "vec")
    want = knn(p, q, 5, name).groupBy("query_id").agg(F.max("dist").alias("kth"))
    found = VPTree.build(p, name, bucket=10).knn(q, 5) if method == "vptree" else graph_index(p, method, name).knn(q, 5, 40)
    good = found.join(want, "query_id").where("dist <= kth + 1e-9").count()
    assert good >= (25 if method == "vptree" and space(name).metric else 20)


def test_experiment(spark, points, tmp_path):
    from vicinity.plans import experiment

    labelled = points.withColumn("label", (F.col("id") % 3).cast("int"))
    for _ in range(2):  # the second run reads the cached answers
        got = experiment.run(spark, labelled, "l2", "hnsw", 5, index_params=["M=8", "efConstruction=40"], query_params=[["ef=10"], ["ef=60"]], sets=2, queries=8, cache=str(tmp_path / "gold")).orderBy("recall").collect()
        assert [r.method for r in got] == ["hnsw", "hnsw"] and got[-1].recall >= 0.9 and got[-1].rel_pos_error >= 1
    labelled.write.parquet(str(tmp_path / "points"))
    experiment.main(["--points", str(tmp_path / "points"), "--space", "l2", "--method", "brute_force", "--knn", "3", "--maxNumQuery", "5", "--output", str(tmp_path / "report")])
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "report")).first().recall == "1.0"
    asked = points.where("id < 4").select(F.col("id").alias("query_id"), "vec")
    for more in ({"radius": 3.0}, {"eps": 0.5, "recall_only": True}):
        got = experiment.run(spark, points, "l2", "vptree", 5, asked=asked, **more).first()
        assert got.recall >= 0.5 and got.num_closer is None


def test_binary_readers(spark, tmp_path):
    import struct

    path = tmp_path / "v.fvecs"
    path.write_bytes(struct.pack("<i2f", 2, 0.5, 1.5) + struct.pack("<i2f", 2, 2.5, 3.5))
    assert [r.vec for r in text.read_texmex(spark, str(path)).orderBy("id").collect()] == [[0.5, 1.5], [2.5, 3.5]]
    path = tmp_path / "s.bin"
    path.write_bytes(struct.pack("<I", 1) + struct.pack("<I", 2) + b"ab" + struct.pack("<I", 2) + struct.pack("<IfIf", 7, 1.0, 3, 2.0))
    got = text.read_sparse_binary(spark, str(path)).first()
    assert (got.extern_id, [tuple(e) for e in got.vec]) == ("ab", [(3, 2.0), (7, 1.0)])
    assert text.read_weights(["a 1 0.5", "", "b 2 0"]) == ({"a": 1.0, "b": 2.0}, {"a": 0.5, "b": 0.0})
    with pytest.raises(ValueError):
        text.read_weights(["a 1"])


def test_combined_records(spark, tmp_path):
    import struct

    path = tmp_path / "fusion.bin"
    record = lambda name, sparse, dense: struct.pack("<I", len(name)) + name + struct.pack("<I", len(sparse)) + b"".join(struct.pack("<If", *e) for e in sparse) + struct.pack("<2f", *dense)
    path.write_bytes(struct.pack("<IIIIII", 2, 2, 1, 0, 0, 2) + record(b"a", [(5, 1.0), (2, 0.5)], (1.0, 2.0)) + record(b"bc", [], (0.0, -1.0)))
    rows = text.read_fusion(spark, str(path)).orderBy("id").collect()
    assert [(r.extern_id, [tuple(e) for e in r.vec.p0], r.vec.p1) for r in rows] == [("a", [(2, 0.5), (5, 1.0)], [1.0, 2.0]), ("bc", [], [0.0, -1.0])]
    index, query = text.read_fusion_weights(["queryWeights: 1 2", "indexWeights: 0.5,0.25"])
    assert (index, query) == ({"p0": 0.5, "p1": 0.25}, {"p0": 1.0, "p1": 2.0})
    from vicinity.functions.distances import fusion

    points = text.read_fusion(spark, str(path))
    got = knn(points, points.where("id = 0").select(F.col("id").alias("query_id"), "vec"), 2, fusion(query, sparse=("p0",))).orderBy("rank").collect()
    assert [(r.id, r.dist) for r in got] == [(0, pytest.approx(-(1.25 + 2 * 5))), (1, pytest.approx(4.0))]
    with pytest.raises(ValueError):
        text.read_fusion_weights(["queryWeights: 1", "indexWeights: 1 2"])
