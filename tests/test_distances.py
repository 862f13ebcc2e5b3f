"""Distances against closed forms, their properties, and their edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vicinity.functions import vectors
from vicinity.functions.distances import SPACES, distance, fusion, register, space
from vicinity.operators.knn import BATCHED, knn, knn_batched


def one(spark, name, v, q, kind="array<double>", **params):
    df = spark.createDataFrame([(v, q)], f"v {kind}, q {kind}")
    return df.select(distance(name, **params)(F.col("v"), F.col("q")).alias("d")).first()[0]


@pytest.mark.parametrize(("name", "want"), [("l1", 7.0), ("l2", 5.0), ("linf", 4.0), ("l2sqr", 25.0), ("negdotprod", -11.0)])
def test_dense_values(spark, name, want):
    assert one(spark, name, [1.0, 2.0, 3.0], [4.0, -2.0, 3.0 + 0.0]) == pytest.approx(want if name != "negdotprod" else -(4 - 4 + 9))


def test_zero_vectors(spark):
    zero = [0.0, 0.0]
    assert one(spark, "cosinesimil", zero, zero) == 1.0
    assert one(spark, "angulardist", zero, [1.0, 0.0]) == pytest.approx(math.pi / 2)
    sparse = "array<struct<dim:int,val:double>>"
    assert one(spark, "cosinesimil_sparse", [(0, 1.0)], [], sparse) == 1.0
    assert one(spark, "cosinesimil_sparse_fast", [], [], sparse) == 1.0
    assert one(spark, "cosinesimil_sparse", [(0, 1.0)], [(1, 1.0)], sparse) == 1.0


def test_lp_reroutes_and_checks(spark):
    v, q = [1.0, 5.0], [2.0, 3.0]
    for p, other in ((1, "l1"), (2, "l2"), (-1, "linf")):
        assert one(spark, "lp", v, q, p=p) == one(spark, other, v, q)
    with pytest.raises(ValueError):
        distance("lp", p=0)
    with pytest.raises(ValueError):
        distance("lp")


def test_unknown_names():
    with pytest.raises(ValueError):
        space("nope")
    with pytest.raises(ValueError):
        distance("l2", p=3)


def test_divergences_of_zeros_do_not_fail(spark):
    v, q = [0.0, 0.5, 0.5], [0.5, 0.5, 0.0]
    for name, s in SPACES.items():
        if s.kind == "distribution":
            assert one(spark, name, v, q) is not None, name
            assert one(spark, name, q, q) == pytest.approx(one(spark, name, q, q))
    assert one(spark, "jsdivfast", q, q) == pytest.approx(0)


def test_symmetry_and_identity(spark):
    r = random.Random(4)
    rows = [([r.random() + 0.01 for _ in range(6)], [r.random() + 0.01 for _ in range(6)]) for _ in range(10)]
    df = spark.createDataFrame(rows, "v array<double>, q array<double>")
    for name, s in SPACES.items():
        if s.kind in ("dense", "distribution") and s.symmetric and None not in s.params.values():
            f = distance(name)
            for x in df.select(f(F.col("v"), F.col("q")).alias("a"), f(F.col("q"), F.col("v")).alias("b"), f(F.col("v"), F.col("v")).alias("z")).collect():
                assert x.a == pytest.approx(x.b), name
                if s.metric:
                    assert x.z == pytest.approx(0, abs=1e-6), name


@pytest.mark.parametrize(("a", "b", "want"), [("", "", 0), ("xyz", "", 3), ("abc", "adc", 1), ("é", "e", 2), ("kitten", "sitting", 3)])
def test_levenshtein_by_bytes(spark, a, b, want):
    assert one(spark, "leven", a, b, "string") == want
    assert one(spark, "leven_char", "é", "e", "string") == 1


def test_bits_with_the_highest_bit(spark):
    assert one(spark, "bit_hamming", [-1], [0], "array<int>") == 32
    assert one(spark, "bit_jaccard", [-1, 0], [1, 0], "array<int>") == pytest.approx(1 - 1 / 32)
    assert one(spark, "bit_jaccard", [0], [0], "array<int>") == 0


def test_jaccard_of_an_empty_set(spark):
    assert one(spark, "jaccard_sparse", [], [1], "array<int>") == 0
    assert one(spark, "jaccard_sparse", [1, 2], [2, 3], "array<int>") == pytest.approx(2 / 3)


def test_sqfd_closed_form(spark):
    kind = "array<struct<centroid:array<double>,weight:double>>"
    v, q = [([0.0], 1.0)], [([3.0], 1.0)]
    # w = (1, -1); similarities -|x - y|: w A w = 2 * 3
    assert one(spark, "sqfd_minus_func", v, q, kind) == pytest.approx(math.sqrt(6))
    assert one(spark, "sqfd_gaussian_func", v, q, kind, alpha=1.0) == pytest.approx(math.sqrt(2 - 2 * math.exp(-9)))
    assert one(spark, "sqfd_heuristic_func", v, q, kind, alpha=1.0) == pytest.approx(math.sqrt(2 - 2 / 4))


def test_fusion_ignores_weights_that_are_not_positive(spark):
    df = spark.createDataFrame([(([1.0, 2.0], [3.0]),)], "v struct<a:array<double>,b:array<double>>")
    assert df.select(fusion({"a": 2.0, "b": -1.0})(F.col("v"), F.col("v")).alias("d")).first().d == -10


def test_own_space(spark):
    register("half_l1", "dense", lambda: lambda v, q: distance("l1")(v, q) / 2)
    try:
        assert one(spark, "half_l1", [1.0], [4.0]) == 1.5
    finally:
        del SPACES["half_l1"]


@pytest.mark.parametrize("name", BATCHED)
def test_matrix_form_agrees(spark, name):
    r = random.Random(5)
    p = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(5)]) for i in range(60)], "id long, vec array<double>")
    q = p.where("id < 4").select(F.col("id").alias("query_id"), "vec")
    a = {(x.query_id, x.rank): (x.id, x.dist) for x in knn(p, q, 7, name).collect()}
    b = {(x.query_id, x.rank): (x.id, x.dist) for x in knn_batched(p, q, 7, name).collect()}
    assert a.keys() == b.keys()
    assert all(a[k][0] == b[k][0] and a[k][1] == pytest.approx(b[k][1], abs=1e-6) for k in a)


def test_bregman_round_trip(spark):
    df = spark.createDataFrame([([0.2, 0.8],)], "v array<double>")
    for kind in ("kl", "itakurasaito"):
        back = df.select(vectors.bregman_inverse_gradient(vectors.bregman_gradient(F.col("v"), kind), kind).alias("x")).first().x
        assert back == pytest.approx([0.2, 0.8])


def _payloads(kind, r):
    dense = [r.random() + 0.01 for _ in range(6)]
    return {
        "dense": dense,
        "distribution": [x / sum(dense) for x in dense],
        "rank": [float(x) for x in r.sample(range(6), 6)],
        "dense_uint8": [r.randint(0, 255) for _ in range(6)],
        "sparse": sorted({r.randint(0, 9): r.random() for _ in range(4)}.items()),
        "set": sorted({r.randint(0, 9) for _ in range(4)}),
        "bits": [r.randint(-(1 << 31), (1 << 31) - 1) for _ in range(2)],
        "string": "".join(r.choice("abcé") for _ in range(r.randint(0, 9))),
    }[kind]


KINDS = {"sparse": "array<struct<dim:int,val:double>>", "set": "array<int>", "bits": "array<int>", "string": "string", "dense_uint8": "array<int>"}


def test_block_forms_agree(spark):
    """Every block form against the column expression."""
    import numpy as np

    from vicinity.functions.kernels import KERNELS, block, kernel

    r = random.Random(8)
    for name in KERNELS:
        s, params = space(name), {"p": 3.0} if "p" in space(name).params else {}
        rows = [(_payloads(s.kind, r), _payloads(s.kind, r)) for _ in range(4)]
        kind = KINDS.get(s.kind, "array<double>")
        df = spark.createDataFrame(rows, f"v {kind}, q {kind}")
        want = [x.d for x in df.select(distance(name, **params)(F.col("v"), F.col("q")).alias("d")).collect()]
        table = df.toArrow()
        got = np.diag(kernel(name, block(table.column("v"), name), block(table.column("q"), name), **params))
        assert got == pytest.approx(want, abs=1e-6), name
