"""Searches at size: payloads that repeat, and points that need no expression."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity import catalog
from vicinity.functions.bounds import BOUNDS, Sparse, fusion_bounds
from vicinity.functions.distances import fusion
from vicinity.operators import knn as plans
from vicinity.operators import refine


@pytest.fixture
def asked(monkeypatch):
    """Pairs whose distance an expression gives, for each plan that was made."""
    seen, plain = [], plans.pairs

    def counted(points, queries, *args, **params):
        seen.append(points.count() * queries.count())
        return plain(points, queries, *args, **params)

    monkeypatch.setattr(plans, "pairs", counted)
    monkeypatch.setattr(refine, "pairs", counted)
    return seen


@pytest.mark.parametrize("name", ["leven", "leven_char", "normleven"])
def test_names_that_repeat_are_compared_once(spark, small, asked, name):
    folder = small.replace("sf0.001", "sf0.1")
    parts = spark.read.parquet(f"{folder}/part.parquet")
    names = parts.select("p_name").distinct().count()
    assert catalog.queries()[name](spark, folder).count() == 10 * parts.where("p_partkey % 50 = 0").count()
    assert sum(asked) <= 10 * names * names


def test_distinct_payloads_give_the_same_rows(spark):
    r = random.Random(6)
    words = [None, "", *("".join(r.choice("abé") for _ in range(r.randint(0, 5))) for _ in range(30))]
    p = spark.createDataFrame([(i * 7 % 307, r.choice(words)) for i in range(300)], "id long, vec string")
    q = p.where("id % 3 = 0").select(F.col("id").alias("query_id"), "vec")
    for k in (1, 7, 400):
        want, got = ({tuple(x) for x in f(p, q, k, "leven").select("query_id", "rank", "id", "dist").collect()} for f in (plans.knn, plans.knn_distinct))
        assert got == want


@pytest.mark.parametrize("name", ["sqfd_minus", "sqfd_heuristic", "sqfd_gaussian", "fusion_negdot", "js_div_expression", "knn_cosine_expression", "sparse_cosine_expression"])
def test_points_far_away_need_no_expression(spark, small, asked, name):
    assert catalog.queries()[name](spark, small).count() > 0
    assert sum(asked) == 0


NAN = float("nan")


def _signature(r, clusters, width=3):
    return [([r.gauss(0, 1) for _ in range(width)], r.random()) for _ in range(clusters)]


def _payloads(space, r):
    """Payloads with copies, close ones, and some that bounds cannot read."""
    if space.startswith("sqfd"):
        some = [_signature(r, r.randint(1, 3)) for _ in range(60)]
        odd = [None, [], _signature(r, 2, 4), [([NAN, 0.0, 1.0], 1.0)], [([1e80, 0.0, 1.0], 1.0)]]
        return "array<struct<centroid:array<double>,weight:double>>", [*some, *some[:30], *[some[3]] * 20], odd
    if space == "cosinesimil":
        some = [[r.gauss(0, 1) for _ in range(5)] for _ in range(60)]
        near = [[x * (1 + 1e-14 * i) for x in some[5]] for i in range(20)]  # equal but for rounding
        return "array<double>", [*some, *some[:30], *near, [0.0] * 5, [1.6e-19, 0.0, 0.0, 0.0, 0.0]], [None, [], [1.0], [NAN] * 5, [None, 1.0, 0.0, 0.0, 0.0], [1e200] * 5, [math.inf] * 5]
    if space == "cosinesimil_sparse":
        some = [sorted({r.randint(0, 40): r.gauss(0, 1) for _ in range(6)}.items()) for _ in range(60)]
        return "array<struct<dim:int,val:double>>", [*some, *some[:30], *[some[2]] * 20, []], [None, [(3, NAN)], [(5, 1.0), (2, 1.0)], [(1, None)], [(1, 1e200)]]
    if space == "jsdivfast":
        some = [[r.choice([0.0, r.random()]) for _ in range(6)] for _ in range(60)]
        return "array<double>", [*some, *some[:30], *[[x + 1e-12 * i for x in some[4]] for i in range(20)], [0.0] * 6], [None, [], [1.0], [NAN] * 6, [-1.0, *[0.5] * 5], [1e-35] * 6, [1e40] * 6]
    if space == "fusion":
        kind, some, odd = _payloads("cosinesimil_sparse", r)
        dense = lambda: [r.gauss(0, 1) for _ in range(4)]
        rows = [(v, dense()) for v in some]
        return f"struct<terms:{kind},dense:array<double>>", [*rows, *rows[:30]], [None, *[(v, dense()) for v in odd], (some[0], None), (some[0], [1.0]), (some[0], [NAN] * 4)]
    raise ValueError(space)


def _rows(df):
    return {(x.query_id, x.rank, x.id, repr(x.dist)) for x in df.collect()}


@pytest.mark.parametrize(("space", "params"), [("sqfd_minus_func", {}), ("sqfd_heuristic_func", {"alpha": 0.5}), ("sqfd_gaussian_func", {"alpha": 2.0}), ("fusion", {}), ("jsdivfast", {}), ("cosinesimil", {}), ("cosinesimil_sparse", {})])
def test_refined_search_gives_the_same_rows(spark, space, params):
    kind, some, odd = _payloads(space, random.Random(9))
    dist, bounds = space, None
    if space == "fusion":
        weights = {"terms": 0.7, "dense": 0.3}
        dist, bounds = fusion(weights, ("terms",)), fusion_bounds(weights, ("terms",))
    for values in (some, [*some[:20], *odd, *some[20:]]):
        p = spark.createDataFrame([(i * 7 % 307, v) for i, v in enumerate(values)], f"id long, vec {kind}").repartition(3, "id")
        q = p.where("id % 4 = 0").select(F.col("id").alias("query_id"), "vec")
        for k in (3, 200):
            assert _rows(refine.knn_refined(p, q, k, dist, bounds=bounds, **params)) == _rows(plans.knn(p, q, k, dist, **params))


def _form(space, q, x, **params):
    """Exact values of the form of all queries and points, and its size without cancellation."""
    similar = {"sqfd_minus_func": lambda d: -d, "sqfd_heuristic_func": lambda d: 1 / (params["alpha"] + d), "sqfd_gaussian_func": lambda d: np.exp(-params["alpha"] * d * d)}[space]
    out = np.empty((len(q[0]), len(x[0])))
    for j, i in np.ndindex(out.shape):
        c, w = np.concatenate((q[0][j], x[0][i])).astype(np.longdouble), np.concatenate((q[1][j], -x[1][i])).astype(np.longdouble)
        out[j, i] = max(0, w @ similar(np.sqrt(np.square(c[:, None] - c[None]).sum(2))) @ w)
    return out


@pytest.mark.parametrize(("space", "params"), [("sqfd_gaussian_func", {"alpha": 1.0}), ("sqfd_gaussian_func", {"alpha": 1e-9}), ("sqfd_gaussian_func", {"alpha": 30.0}), ("sqfd_minus_func", {}), ("sqfd_heuristic_func", {"alpha": 1.0}), ("sqfd_heuristic_func", {"alpha": 0.01})])
def test_bounds_of_signatures_hold(space, params):
    r = np.random.default_rng(4)
    for size in (1e-9, 1e-3, 1.0, 40.0, 1e6):
        for apart in (1.0, 1e-7):
            both = [size * (1 + apart * r.normal(size=(n, 3, 5))) for n in (8, 30)]
            both[1][:4] = both[0][:4]
            q, x = ([c, 10.0 ** r.integers(-3, 3) * r.random((len(c), 3))] for c in both)
            x[1][:2] = q[1][:2]
            form = BOUNDS[space](**params)
            ((at, block),) = form.prepare(q)
            low, high = form.bounds(x, block)
            want = _form(space, q, x, **params)
            assert low.shape == want.shape and (low <= want).all() and (want <= high).all()


@pytest.mark.parametrize(("space", "params"), [("sqfd_gaussian_func", {"alpha": 1.0}), ("sqfd_minus_func", {}), ("sqfd_heuristic_func", {"alpha": 1.0})])
def test_pairs_of_clusters_in_single_precision(space, params):
    r, seen = np.random.default_rng(4), []
    form = BOUNDS[space](**params)
    plain = form.similar
    form.similar = lambda d: (seen.append(d.dtype) if d.ndim == 2 else None, plain(d))[1]
    q, x = ([r.normal(0, 0.125, (n, 4, 16)), r.dirichlet(np.ones(4), n)] for n in (20, 50))
    ((at, block),) = form.prepare(q)
    low, high = form.bounds(x, block)
    assert len(seen) == 16 and set(seen) == {np.dtype(np.float32)}
    assert (high - low).max() < 1e-2 * high.max()  # and still tell points apart


def test_points_of_one_file_are_dealt_over_the_cores(spark, small):
    p = spark.read.parquet(f"{small}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    assert refine._dealt(p).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > p.rdd.getNumPartitions()
    assert refine._dealt(p).count() == p.count()


def test_blocks_of_near_pairs_are_not_sorted(monkeypatch):
    r, sorted_rows, plain = np.random.default_rng(2), [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, *a, **b: (sorted_rows.append(len(keys[0])), plain(keys, *a, **b))[1])
    d, near = r.integers(0, 300, (20, 5000)) / 1.0, refine.Near(20, 3)
    for a in range(0, 5000, 1000):
        b = slice(a, a + 1000)
        near.add(slice(0, 20), np.arange(5000)[b], np.stack([np.arange(5000)[b]] * 2), d[:, b] - 0.5, d[:, b] + 0.5)
    assert sum(sorted_rows) < 2000
    near.compact()
    ((j, i, *_),) = near.found
    most = np.sort(d, 1)[:, 2:3] + 1
    assert {*zip(j.tolist(), i.tolist(), strict=True)} == {*zip(*(x.tolist() for x in np.nonzero(d <= most)), strict=True)}


def test_sparse_rows_stay_in_one_array(spark):
    rows = [[(1, 0.5), (9, 2.0)], [], [(0, -1.0)], [(3, 4.0), (4, 5.0), (7, 6.0)], [(9, 1.0), (2, 1.0)], [(2, 1.0), (2, 1.0)], [(2, None)], None]
    p = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "id long, vec array<struct<dim:int,val:double>>").coalesce(1)
    kind = Sparse()
    assert [x.id for x in p.where(kind.plain(F.col("vec"), 0)).collect()] == [0, 1, 2, 3]
    read = kind.read(p.where("id < 4").select("vec").toArrow().column("vec").combine_chunks(), 0)
    assert [x.values.size for x in read] == [6, 6]
    for at in (slice(0, 4), slice(1, 3), slice(2, 9), slice(1, 2)):
        part, dims = [x[at] for x in read], np.array([3, 9])
        m, square = kind.table(part, dims)
        want = rows[:4][at]
        assert len(part[0]) == len(want) and m.tolist() == [[dict(v).get(d, 0.0) for d in dims.tolist()] for v in want]
        assert square.tolist() == [sum(x * x for _, x in v) for v in want] and kind.dims(part).tolist() == sorted({d for v in want for d, _ in v})
