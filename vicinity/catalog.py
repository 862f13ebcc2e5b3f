"""Every query of the library by name, with the SQL that states the same result.

Distances are computed in double precision in both engines and rounded to six digits in the output only; ranks
follow (distance, id).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors as vec
from .functions.bounds import BOUNDS, fusion_bounds
from .functions.distances import distance, fusion
from .operators import evaluation as ev
from .operators import graphs, inverted
from .operators.knn import classify, knn, knn_batched, knn_distinct, knn_graph as self_graph, search, search_range, top_k
from .operators.refine import knn_refined
from .operators.vptree import VPTree
from .storage import shared_folder, stored
from .streaming.search import append_points, stored_points

#: Neighbours of a query; queries are the rows whose id is divisible by EVERY, against all rows.
K, EVERY = 10, 50
Query = Callable[[SparkSession, str], DataFrame]


def _points(spark: SparkSession, sf_dir: str, payload: Callable[[Column], Column] | None = None) -> DataFrame:
    v = vec.doubles(F.col("embedding"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), (payload(v) if payload else v).alias("vec"), "label")


def _queries(points: DataFrame) -> DataFrame:
    return points.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "vec")


def _rounded(df: DataFrame) -> DataFrame:
    """Results with distances as doubles of six digits."""
    return df.withColumn("dist", F.round(F.col("dist").cast("double") + 0.0, 6))


# payloads in both engines: Spark's function and DuckDB's expression over ``v``, a list of doubles
DENSE = (None, "v")
DISTRIBUTION = (vec.distribution, "list_transform(v, lambda x: (abs(x) + 1e-3) / list_sum(list_transform(v, lambda y: abs(y) + 1e-3)))")
SIFT = (lambda v: F.transform(v, lambda x: F.floor((x + 1) * 127).cast("int")), "list_transform(v, lambda x: CAST(floor((x + 1) * 127) AS INTEGER))")
SPARSE = (lambda v: vec.sparse(v, 0.15), "list_transform(v, lambda x: CASE WHEN abs(x) > 0.15 THEN x ELSE 0.0 END)")
SETS = (vec.positive_set, "list_filter(range(0, 64), lambda i: v[i + 1] > 0)")
BITS = (lambda v: vec.bit_words(v, 64), "list_transform(v, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)")
RANKS = (vec.ranks, "list_transform(range(1, 65), lambda i: len(list_filter(range(1, 65), lambda j: v[j] < v[i] OR (v[j] = v[i] AND j < i))))")

_Z = "list_transform(list_zip(v, q), lambda z: {})"


def _each(expression: str) -> str:
    """The sum over pairs of elements x and y."""
    return f"list_sum({_Z.format(expression.replace('#x', 'z[1]').replace('#y', 'z[2]'))})"


_COS = "greatest(-1.0, least(1.0, list_sum(list_transform(list_zip(v, q), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x))))))"
_JS = f"greatest(0.0, 0.5 * {_each('#x * ln(#x) + #y * ln(#y) - (#x + #y) * ln((#x + #y) / 2)')})"
_BOTH = "len(list_intersect(v, q))"
#: Name of the query: space, parameters, payload, and DuckDB's distance over v (the object) and q (the query).
KNN: dict[str, tuple] = {
    "knn_l1": ("l1", {}, DENSE, _each("abs(#x - #y)")),
    "knn_l2": ("l2", {}, DENSE, f"sqrt({_each('(#x - #y) * (#x - #y)')})"),
    "knn_l2sqr": ("l2sqr", {}, DENSE, _each("(#x - #y) * (#x - #y)")),
    "knn_linf": ("linf", {}, DENSE, f"list_max({_Z.format('abs(z[1] - z[2])')})"),
    "knn_lp3": ("lp", {"p": 3}, DENSE, f"pow({_each('pow(abs(#x - #y), 3.0)')}, 1.0 / 3)"),
    "knn_lp_half": ("lp", {"p": 0.5}, DENSE, f"pow({_each('pow(abs(#x - #y), 0.5)')}, 2.0)"),
    "knn_cosine": ("cosinesimil", {}, DENSE, f"greatest(0.0, 1 - {_COS})"),
    "knn_angular": ("angulardist", {}, DENSE, f"acos({_COS})"),
    "knn_negdot": ("negdotprod", {}, DENSE, f"-{_each('#x * #y')}"),
    "knn_querynorm_negdot": ("querynorm_negdotprod", {}, DENSE, f"-{_each('#x * #y')} / sqrt(list_sum(list_transform(q, lambda x: x * x)))"),
    "knn_word_embed": ("word_embed", {"dist": "l2"}, DENSE, f"sqrt({_each('(#x - #y) * (#x - #y)')})"),
    "knn_sift_l2sqr": ("l2sqr_sift", {}, SIFT, _each("(#x - #y) * (#x - #y)")),
    "kl": ("kldivfast", {}, DISTRIBUTION, _each("#x * (ln(#x) - ln(#y))")),
    "kl_rq": ("kldivfastrq", {}, DISTRIBUTION, _each("#y * (ln(#y) - ln(#x))")),
    "klgen": ("kldivgenfast", {}, DISTRIBUTION, _each("#x * (ln(#x) - ln(#y)) + #y - #x")),
    "klgen_slow": ("kldivgenslow", {}, DISTRIBUTION, _each("#x * ln(#x / #y) + #y - #x")),
    "klgen_rq": ("kldivgenfastrq", {}, DISTRIBUTION, _each("#y * (ln(#y) - ln(#x)) + #x - #y")),
    "itakura": ("itakurasaitofast", {}, DISTRIBUTION, _each("#x / #y - ln(#x / #y) - 1")),
    "itakura_rq": ("itakurasaitofastrq", {}, DISTRIBUTION, _each("#y / #x - ln(#y / #x) - 1")),
    "js_div": ("jsdivfast", {}, DISTRIBUTION, _JS),
    "js_metric": ("jsmetrfast", {}, DISTRIBUTION, f"sqrt({_JS})"),
    "renyi": ("renyidiv_fast", {"alpha": 0.5}, DISTRIBUTION, f"greatest(0.0, ln({_each('#x * pow(#x / #y, -0.5)')}) / -0.5)"),
    "alphabeta": ("abdiv_fast", {"alpha": 1, "beta": 1}, DISTRIBUTION, _each("#x * #x * #y")),
    "bit_hamming": ("bit_hamming", {}, BITS, _each("CASE WHEN #x = #y THEN 0 ELSE 1 END")),
    "bit_jaccard": ("bit_jaccard", {}, BITS, f"1 - {_each('least(#x, #y)')}::DOUBLE / {_each('greatest(#x, #y)')}"),
    "set_jaccard": ("jaccard_sparse", {}, SETS, f"1 - {_BOTH}::DOUBLE / (len(v) + len(q) - {_BOTH})"),
    "footrule": ("footrule", {}, RANKS, _each("abs(#x - #y)")),
    "spearman_rho": ("spearman_rho", {}, RANKS, _each("(#x - #y) * (#x - #y)")),
    "sparse_l1": ("l1_sparse", {}, SPARSE, _each("abs(#x - #y)")),
    "sparse_l2": ("l2_sparse", {}, SPARSE, f"sqrt({_each('(#x - #y) * (#x - #y)')})"),
    "sparse_linf": ("linf_sparse", {}, SPARSE, f"list_max({_Z.format('abs(z[1] - z[2])')})"),
    "sparse_lp3": ("lp_sparse", {"p": 3}, SPARSE, f"pow({_each('pow(abs(#x - #y), 3.0)')}, 1.0 / 3)"),
    "sparse_cosine": ("cosinesimil_sparse", {}, SPARSE, f"greatest(0.0, 1 - {_COS})"),
    "sparse_angular": ("angulardist_sparse_fast", {}, SPARSE, f"acos({_COS})"),
    "sparse_negdot": ("negdotprod_sparse_fast", {}, SPARSE, f"-{_each('#x * #y')}"),
    "sparse_querynorm": ("querynorm_negdotprod_sparse_fast", {}, SPARSE, f"-{_each('#x * #y')} / sqrt(list_sum(list_transform(q, lambda x: x * x)))"),
}
#: Further names of spaces above, each answered by a query of its own.
SAME_AS = {
    "itakura_slow": ("itakurasaitoslow", "itakura"),
    "js_div_slow": ("jsdivslow", "js_div"),
    "js_div_approx": ("jsdivfastapprox", "js_div"),
    "js_metric_slow": ("jsmetrslow", "js_metric"),
    "renyi_slow": ("renyidiv_slow", "renyi"),
    "alphabeta_slow": ("abdiv_slow", "alphabeta"),
    "sparse_angular_plain": ("angulardist_sparse", "sparse_angular"),
    "sparse_negdot_plain": ("negdotprod_sparse", "sparse_negdot"),
    "sparse_querynorm_plain": ("querynorm_negdotprod_sparse", "sparse_querynorm"),
    "sparse_cosine_fast": ("cosinesimil_sparse_fast", "sparse_cosine"),
    "sparse_cosine_bin": ("cosinesimil_sparse_bin_fast", "sparse_cosine"),
    "sparse_negdot_bin": ("negdotprod_sparse_bin_fast", "sparse_negdot"),
}
KNN |= {name: (space, *KNN[other][1:]) for name, (space, other) in SAME_AS.items()}


def _base(payload: str, where: str = "TRUE") -> str:
    return f"b AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT id, label, {payload} AS v FROM b), q AS (SELECT id AS query_id, v AS q FROM p WHERE id % {EVERY} = 0), d AS (SELECT query_id, id, {{}} AS dist FROM p, q WHERE {where})"


_TOP = f"SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS INTEGER) AS rank, id, round(CAST(dist AS DOUBLE) + 0.0, 6) AS dist FROM d QUALIFY rank <= {K}"


def _knn_sql(payload: str, dist: str, where: str = "TRUE") -> str:
    return f"WITH {_base(payload, where).replace('{}', dist)} {_TOP}"


def _knn_query(name: str) -> Query:
    space, params, (payload, _), _ = KNN[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = _points(spark, sf_dir, payload)
        return _rounded(search(p, _queries(p), K, space, params=params))

    return run


def _expression(name: str) -> Query:
    """The same search by the space's column expression."""
    space, params, (payload, _), _ = KNN[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = _points(spark, sf_dir, payload)
        return _rounded(knn_refined(p, _queries(p), K, space, **params) if space in BOUNDS else knn(p, _queries(p), K, distance(space, **params)))

    return run


#: Searches that are answered by expressions too: one for each kind of payload.
EXPRESSIONS = ("knn_l2", "knn_cosine", "klgen", "js_div", "sparse_cosine", "set_jaccard", "bit_hamming", "footrule")


def range_l2(spark, sf_dir):
    p = _points(spark, sf_dir)
    return _rounded(search_range(p, _queries(p), 1.2, "l2"))


def range_cosine(spark, sf_dir):
    p = _points(spark, sf_dir)
    return _rounded(search_range(p, _queries(p), 0.7, "cosinesimil"))


def knn_l2_batched(spark, sf_dir):
    p = _points(spark, sf_dir)
    return _rounded(knn_batched(p, _queries(p), K, "l2"))


def knn_cosine_batched(spark, sf_dir):
    p = _points(spark, sf_dir)
    return _rounded(knn_batched(p, _queries(p), K, "cosinesimil"))


def knn_graph(spark, sf_dir):
    p = _points(spark, sf_dir)
    return _rounded(self_graph(p, 5, "l2"))


def filtered_knn(spark, sf_dir):
    p = _points(spark, sf_dir)
    return _rounded(search(p.where(F.col("label") < 5), _queries(p), K, "l2"))


def point_distance(spark, sf_dir):
    p = _points(spark, sf_dir)
    a, b = p.select(F.col("id").alias("a"), F.col("vec").alias("x")), p.select(F.col("id").alias("b"), F.col("vec").alias("y"))
    f = distance("l2")
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(f(F.col("x"), F.col("y")), 6).alias("dist"))


def _strings(name: str) -> Query:
    def run(spark, sf_dir):
        p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("vec"))
        return _rounded(knn_distinct(p, _queries(p), K, name))

    return run


def _strings_sql(dist: str) -> str:
    return f"WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS v FROM part), d AS (SELECT x.id AS query_id, p.id, {dist} AS dist FROM p, p x WHERE x.id % {EVERY} = 0) {_TOP}"


def invindex_topk(spark, sf_dir):
    p = _points(spark, sf_dir, SPARSE[0])
    return _rounded(inverted.inverted_knn(inverted.postings(p), _queries(p), K))


def postings(spark, sf_dir):
    posted = inverted.postings(_points(spark, sf_dir, SPARSE[0]))
    return posted.groupBy("key").agg(F.count("*").alias("docs"), F.round(F.sum("val"), 6).alias("total"))


#: Pivots, those of the smallest hash of their id in the whole table, and how many of each point are kept.
PIVOTS, PREFIX = 64, 8


def _pivots(p: DataFrame) -> DataFrame:
    return inverted.choose_pivots(p, PIVOTS)


_PIVOTS = "piv AS (SELECT row_number() OVER (ORDER BY id) - 1 AS pivot_id, v AS w FROM (SELECT * FROM p ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 64)), tp AS (SELECT p.id, pivot_id, sqrt(list_sum(list_transform(list_zip(w, v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist FROM p, piv), pre AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY dist, pivot_id) AS INTEGER) AS place, CAST(pivot_id AS INTEGER) AS pivot_id FROM tp)"
_P = "b AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT * FROM b)"


def perm_prefix(spark, sf_dir):
    p = _points(spark, sf_dir)
    return inverted.permutation_prefix(inverted.with_prefix(p.select("id", "vec"), _pivots(p), "l2", PREFIX))


def permutation(spark, sf_dir):
    p = _points(spark, sf_dir)
    return inverted.permutation(inverted.with_prefix(p.select("id", "vec"), _pivots(p), "l2", PIVOTS)).select("id", F.array_join(F.transform("ranks", lambda r: r.cast("string")), ",").alias("ranks"))


def pivot_distances(spark, sf_dir):
    p = _points(spark, sf_dir)
    return _rounded(inverted.pivot_distances(p, _pivots(p), "l2"))


def binarized(spark, sf_dir):
    """Bits of each point's permutation, half of them set."""
    p = _points(spark, sf_dir)
    ranks = inverted.permutation(inverted.with_prefix(p.select("id", "vec"), _pivots(p), "l2", PIVOTS))
    words = vec.binarized(F.col("ranks"), PIVOTS // 2, PIVOTS)
    return ranks.select("id", F.aggregate(F.transform(words, lambda w: F.bit_count(w.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit(0), lambda a, x: a + x).alias("ones"))


def napp_postings(spark, sf_dir):
    return perm_prefix(spark, sf_dir).groupBy("pivot_id").agg(F.count("*").alias("points"))


def napp_knn(spark, sf_dir):
    p = _points(spark, sf_dir)
    return _rounded(inverted.napp_knn(p, _queries(p), _pivots(p), K, "l2", num_pivot_index=PREFIX, num_pivot_search=2))


def hash_trick(spark, sf_dir):
    p = _points(spark, sf_dir, SPARSE[0])
    return p.select("id", F.posexplode(vec.hash_trick(F.col("vec"), 8)).alias("pos", "x")).select("id", "pos", F.round("x", 6).alias("val"))


def _overlap(n: int) -> Query:
    def run(spark, sf_dir):
        p = _points(spark, sf_dir, lambda v: vec.positive_set(v)).select("id", "vec")
        a, b, c = (p.select(F.col("id").alias(i), F.col("vec").alias("v" + i)) for i in "abc")
        two = a.join(b, F.col("b") == F.col("a") + 1)
        if n == 2:
            return two.select("a", "b", vec.overlap(F.col("va"), F.col("vb")).alias("shared"))
        return two.join(c, F.col("c") == F.col("a") + 2).select("a", "b", "c", vec.overlap(F.col("va"), F.col("vb"), F.col("vc")).alias("shared"))

    return run


def overlap_info(spark, sf_dir):
    p = _points(spark, sf_dir, SPARSE[0]).select("id", "vec")
    a, b = (p.select(F.col("id").alias(i), F.col("vec").alias("v" + i)) for i in "ab")
    cols = vec.overlap_info(F.col("va"), F.col("vb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", *((c if n == "overlap_qty" else F.round(c, 6)).alias(n) for n, c in cols.items()))


def _overlap_info_sql() -> str:
    stat = lambda name, c: f"round(coalesce(sum({c}), 0), 6) AS {name}_sum, round(coalesce(avg({c}), 0), 6) AS {name}_mean, round(coalesce(stddev_samp({c}), 0), 6) AS {name}_std"
    cases = ", ".join(stat(n, f"CASE WHEN {w} THEN {v} END") for n, w, v in (("overlap_left", "x <> 0 AND y <> 0", "x"), ("diff_left", "x <> 0 AND y = 0", "x"), ("overlap_right", "x <> 0 AND y <> 0", "y"), ("diff_right", "y <> 0 AND x = 0", "y")))
    return f"WITH b AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT id, {SPARSE[1]} AS v FROM b), e AS (SELECT l.id AS a, r.id AS b, unnest(l.v) AS x, unnest(r.v) AS y FROM p l JOIN p r ON r.id = l.id + 1) SELECT a, b, CAST(count(CASE WHEN x <> 0 AND y <> 0 THEN 1 END) AS INTEGER) AS overlap_qty, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS overlap_dotprod_norm, {cases} FROM e GROUP BY a, b"


def vptree_knn(spark, sf_dir):
    p = _points(spark, sf_dir)
    return _rounded(VPTree.build(p, "l2", bucket=50).knn(_queries(p), K))


def vptree_range(spark, sf_dir):
    p = _points(spark, sf_dir)
    return _rounded(VPTree.build(p, "l2", bucket=50).range_search(_queries(p), 1.2))


def gold_standard(spark, sf_dir):
    p = _points(spark, sf_dir)
    return _rounded(ev.gold_standard(p, _queries(p), K, "l2"))


def _approx(p: DataFrame) -> DataFrame:
    """What the pivot index finds in the whole table: the approximate result that the metrics judge."""
    return inverted.napp_knn(p, _queries(p), _pivots(p), K, "l2", num_pivot_index=PREFIX, num_pivot_search=2)


_NAPP = "c AS (SELECT y.id AS query_id, x.id FROM pre x JOIN pre y ON x.pivot_id = y.pivot_id WHERE x.place <= {PREFIX} AND y.place <= {PREFIX} AND y.id % {EVERY} = 0 GROUP BY ALL HAVING count(*) >= 2)".replace("{PREFIX}", str(PREFIX)).replace("{EVERY}", str(EVERY))
_GOLD = _base("v").replace("{}", KNN["knn_l2"][3]) + f", g AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank, id, dist FROM d QUALIFY rank <= {10 * K}), {_PIVOTS}, {_NAPP}, a AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank, id, dist FROM d SEMI JOIN c USING (query_id, id) QUALIFY rank <= {K})"


def recall(spark, sf_dir):
    p = _points(spark, sf_dir)
    return ev.recall(ev.gold_standard(p, _queries(p), K, "l2"), _approx(p), K).select("query_id", F.round("recall", 6).alias("recall"))


def num_closer(spark, sf_dir):
    p = _points(spark, sf_dir)
    return ev.num_closer(ev.gold_standard(p, _queries(p), K, "l2"), _approx(p))


def recall_at_1(spark, sf_dir):
    return ev.recall_at_1(num_closer(spark, sf_dir))


def precision_of_approx(spark, sf_dir):
    p = _points(spark, sf_dir)
    return ev.precision_of_approx(ev.gold_standard(p, _queries(p), K, "l2"), _approx(p)).select("query_id", F.round("precision_of_approx", 6).alias("precision_of_approx"))


def rel_pos_error(spark, sf_dir):
    p = _points(spark, sf_dir)
    return ev.rel_pos_error(ev.gold_standard(p, _queries(p), K, "l2"), _approx(p)).select("query_id", F.round("rel_pos_error", 6).alias("rel_pos_error"))


def metric_summary(spark, sf_dir):
    return ev.summary(recall(spark, sf_dir), "recall").select(F.round("mean", 6).alias("mean"), F.round("half_width", 6).alias("half_width"))


def knn_classify(spark, sf_dir):
    p = _points(spark, sf_dir)
    return classify(search(p, _queries(p), K, "l2"), p)


def class_accuracy(spark, sf_dir):
    p = _points(spark, sf_dir)
    truth = p.select(F.col("id").alias("query_id"), "label")
    return ev.class_accuracy(classify(search(p, _queries(p), K, "l2"), p), truth).select(F.round("class_accuracy", 6).alias("class_accuracy"))


def bootstrap_split(spark, sf_dir):
    return ev.bootstrap_split(_points(spark, sf_dir), 3, 20).groupBy("split").agg(F.count("*").alias("points"))


def intrinsic_dim(spark, sf_dir):
    """Over pairs of neighbouring ids, so that the SQL sees the same pairs."""
    p = _points(spark, sf_dir).select("id", "vec")
    f = distance("l2")
    d = p.join(p.select((F.col("id") - 1).alias("id"), F.col("vec").alias("w")), "id").select(f(F.col("vec"), F.col("w")).alias("d"))
    return d.agg(F.round(F.pow(F.avg("d"), F.lit(2)) / (2 * F.var_pop("d")), 4).alias("intrinsic_dim"))


def intrinsic_dim_sampled(spark, sf_dir):
    return ev.intrinsic_dimensionality(_points(spark, sf_dir))


def _long(p: DataFrame) -> DataFrame:
    return p.select("id", F.posexplode("vec").alias("pos", "x")).select("id", "pos", F.round(F.col("x") + 0.0, 6).alias("val"))


def normalize(spark, sf_dir):
    return _long(_points(spark, sf_dir, lambda v: vec.normalized(F.transform(v, lambda x: x * 3))))


def center(spark, sf_dir):
    return _long(vec.centered(_points(spark, sf_dir), "vec", 64))


def mean_vector(spark, sf_dir):
    return vec.mean_vector(_points(spark, sf_dir), "vec", "label").select("label", "pos", F.round("mean", 6).alias("mean"))


def bregman_mean(spark, sf_dir):
    return vec.mean_vector(_points(spark, sf_dir, vec.distribution), "vec").select("pos", F.round("mean", 6).alias("mean"))


def bregman_gradient(spark, sf_dir):
    return _long(_points(spark, sf_dir, lambda v: vec.bregman_gradient(vec.distribution(v), "kl")))


def projection(spark, sf_dir):
    return _long(_points(spark, sf_dir, lambda v: vec.first_elements(v, 8)))


def _records(v: Column) -> Column:
    return F.struct(vec.sparse(v, 0.15).alias("terms"), v.alias("dense"))


def fusion_negdot(spark, sf_dir):
    p = _points(spark, sf_dir, _records)
    weights, sparse = {"terms": 0.7, "dense": 0.3}, ("terms",)
    return _rounded(knn_refined(p, _queries(p), K, fusion(weights, sparse), bounds=fusion_bounds(weights, sparse)))


def _sqfd(name: str, **params) -> Query:
    """Signatures of four clusters of sixteen numbers, weighted by place."""

    def run(spark, sf_dir):
        cut = lambda v: F.array(*(F.struct(F.slice(v, 16 * i + 1, 16).alias("centroid"), F.lit((i + 1) / 10).alias("weight")) for i in range(4)))
        p = _points(spark, sf_dir, cut)
        return _rounded(knn_refined(p, _queries(p), 5, name, **params))

    return run


def _graph(method: str, **params) -> Query:
    def run(spark, sf_dir):
        p = _points(spark, sf_dir)
        return _rounded(graphs.graph_index(p.select("id", "vec"), method, "l2", **params).knn(_queries(p), K, 100))

    return run


def _found(method: str, ef: int, **params) -> Query:
    """Whether a graph's answers over the whole table reach the recall that its kind is known for."""

    def run(spark, sf_dir):
        p = _points(spark, sf_dir)
        found = graphs.graph_index(p.select("id", "vec"), method, "l2", **params).knn(_queries(p), K, ef)
        got = ev.recall(ev.gold_standard(p, _queries(p), K, "l2", depth=2), found, K)
        return got.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.96).alias("reached"))

    return run


def graph_edges(spark, sf_dir):
    return graphs.graph_index(_points(spark, sf_dir).select("id", "vec"), "sw-graph", "l2").edges()


def graph_nodes(spark, sf_dir):
    """Points that the links of the graph reach, from and to."""
    e = graph_edges(spark, sf_dir)
    return e.select(F.col("src").alias("id")).intersect(e.select(F.col("dst").alias("id")))


def _deleted(spark, sf_dir) -> tuple[DataFrame, graphs.GraphIndex]:
    p = _points(spark, sf_dir)
    return p, graphs.graph_index(p.select("id", "vec"), "sw-graph", "l2", ef_construction=60).delete(p.where("id % 10 = 3").select("id"))


def graph_delete(spark, sf_dir):
    """The nodes of the graph after a tenth of the points was taken out of it."""
    e = _deleted(spark, sf_dir)[1].edges()
    return e.select(F.col("src").alias("id")).distinct()


def graph_add_delete_knn(spark, sf_dir):
    """Whether a graph that points were added to and deleted from still reaches the recall, and returns no deleted point."""
    p = _points(spark, sf_dir)
    rows = p.select("id", "vec")
    index = graphs.graph_index(rows.where("id % 5 < 3"), "sw-graph", "l2", ef_construction=60).add(rows.where("id % 5 >= 3")).delete(p.where("id % 10 = 3").select("id"))
    found = index.knn(_queries(p), K, 120)
    got = ev.recall(ev.gold_standard(p.where("id % 10 <> 3"), _queries(p), K, "l2", depth=2), found, K).agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.93).alias("reached"))
    return got.crossJoin(found.agg(F.count(F.when(F.col("id") % 10 == 3, 1)).alias("deleted_found")))  # one row each


def stream_add_knn(spark, sf_dir):
    """Points that arrive as a stream and are stored by micro-batch, some of them deleted again, searched at the end."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    p = _points(spark, sf_dir)
    stored(p.select("id", "vec").repartition(4, "id"), "arriving", folder)
    arriving = spark.readStream.schema("id long, vec array<double>").option("maxFilesPerTrigger", 1).parquet(f"{folder}/arriving")
    query = append_points(arriving, f"{folder}/points", f"{folder}/progress", once=True)
    query.awaitTermination()
    kept = stored_points(spark, f"{folder}/points", p.where("id % 5 = 4").select("id"))
    return _rounded(search(kept, _queries(p), K, "l2"))


def improvement(spark, sf_dir):
    """Distances that the vantage-point tree saves against a scan, and what it finds: it must find all and save some."""
    p = _points(spark, sf_dir)
    index = VPTree.build(p.select("id", "vec"), "l2", bucket=50)
    n = ev.improvement(p.count(), index.distance_computations(_queries(p), K))
    return n.select((F.col("impr_dist_comp") >= 1).alias("saves"))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: _knn_query(name) for name in KNN}
    out |= {f.__name__: f for f in (range_l2, range_cosine, knn_l2_batched, knn_cosine_batched, knn_graph, filtered_knn, point_distance, invindex_topk, postings, perm_prefix, permutation, napp_postings, napp_knn, hash_trick, overlap_info, vptree_knn, vptree_range, gold_standard, recall, num_closer, recall_at_1, precision_of_approx, rel_pos_error, metric_summary, knn_classify, class_accuracy, bootstrap_split, intrinsic_dim, intrinsic_dim_sampled, normalize, center, mean_vector, bregman_mean, bregman_gradient, projection, fusion_negdot, graph_edges, graph_nodes, graph_delete, graph_add_delete_knn, stream_add_knn, pivot_distances, binarized, improvement)}
    out |= {f"{name}_expression": _expression(name) for name in EXPRESSIONS}
    out |= {"leven_char": _strings("leven_char"), "leven": _strings("leven"), "normleven": _strings("normleven"), "overlap2": _overlap(2), "overlap3": _overlap(3)}
    out |= {"sqfd_minus": _sqfd("sqfd_minus_func"), "sqfd_heuristic": _sqfd("sqfd_heuristic_func", alpha=1.0), "sqfd_gaussian": _sqfd("sqfd_gaussian_func", alpha=1.0)}
    out |= {"hnsw_knn": _graph("hnsw", m=12, ef_construction=80), "swgraph_knn": _graph("sw-graph", m=12, ef_construction=60)}
    out |= {"hnsw_recall": _found("hnsw", 120, m=12, ef_construction=80), "swgraph_recall": _found("sw-graph", 120, m=12, ef_construction=60)}
    return out


def _sqfd_sql(similar: str) -> str:
    pair = similar.replace("#d", "sqrt(list_sum(list_transform(list_zip(s.c, t.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))")
    return f"WITH b AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT id, i, v[16 * i + 1 : 16 * i + 16] AS c, (i + 1) / 10.0 AS w FROM b, range(0, 4) r(i)), pq AS (SELECT p.id, q.id AS query_id FROM b p, b q WHERE q.id % {EVERY} = 0), s AS (SELECT pq.id, query_id, i, c, w FROM pq JOIN c ON c.id = pq.id UNION ALL SELECT pq.id, query_id, i + 4, c, -w FROM pq JOIN c ON c.id = pq.query_id), d AS (SELECT s.id, s.query_id, sqrt(greatest(0.0, sum(s.w * t.w * {pair}))) AS dist FROM s JOIN s t ON s.id = t.id AND s.query_id = t.query_id GROUP BY s.id, s.query_id) {_TOP.replace(f'rank <= {K}', 'rank <= 5')}"


def oracle_sql() -> dict[str, str]:
    out = {name: _knn_sql(payload[1], sql) for name, (_, _, payload, sql) in KNN.items()}
    l2, cos = KNN["knn_l2"][3], KNN["knn_cosine"][3]
    ranged = lambda dist, r: f"WITH {_base('v').replace('{}', dist)} SELECT query_id, id, round(dist, 6) AS dist FROM d WHERE dist <= {r}"
    out |= {"range_l2": ranged(l2, 1.2), "vptree_range": ranged(l2, 1.2), "range_cosine": ranged(cos, 0.7)}
    out |= {"knn_l2_batched": out["knn_l2"], "vptree_knn": out["knn_l2"], "knn_cosine_batched": out["knn_cosine"]}
    out["knn_graph"] = out["knn_l2"].replace(f"WHERE id % {EVERY} = 0", "").replace(f"rank <= {K}", "rank <= 5")
    out["filtered_knn"] = _knn_sql("v", l2, "p.label < 5")
    out["stream_add_knn"] = _knn_sql("v", l2, "p.id % 5 <> 4")
    out["point_distance"] = f"WITH {_P} SELECT x.id AS a, y.id AS b, round(sqrt(list_sum(list_transform(list_zip(x.v, y.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS dist FROM p x JOIN p y ON y.id = x.id + 1"
    out |= {f"{name}_expression": out[name] for name in EXPRESSIONS}
    out |= {"leven_char": _strings_sql("levenshtein(p.v, x.v)"), "leven": _strings_sql("levenshtein(p.v, x.v)"), "normleven": _strings_sql("levenshtein(p.v, x.v)::DOUBLE / greatest(strlen(p.v), strlen(x.v))")}
    sparse = f"b AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), e AS (SELECT id, unnest(range(0, 64)) AS key, unnest(v) AS val FROM b), s AS (SELECT * FROM e WHERE abs(val) > 0.15)"
    out["invindex_topk"] = f"WITH {sparse}, d AS (SELECT y.id AS query_id, x.id, -sum(x.val * y.val) AS dist FROM s x JOIN s y ON x.key = y.key WHERE y.id % {EVERY} = 0 GROUP BY ALL) {_TOP}"
    out["postings"] = f"WITH {sparse} SELECT CAST(key AS INTEGER) AS key, count(*) AS docs, round(sum(val), 6) AS total FROM s GROUP BY key"
    out["hash_trick"] = f"WITH {sparse}, g AS (SELECT id, key % 8 AS pos, sum(val) AS t FROM s GROUP BY ALL) SELECT b.id, CAST(r.pos AS INTEGER) AS pos, round(coalesce(t, 0), 6) AS val FROM b CROSS JOIN range(0, 8) r(pos) LEFT JOIN g ON g.id = b.id AND g.pos = r.pos"
    out["perm_prefix"] = f"WITH {_P}, {_PIVOTS} SELECT * FROM pre WHERE place <= {PREFIX}"
    out["permutation"] = f"WITH {_P}, {_PIVOTS} SELECT id, string_agg(CAST(place - 1 AS VARCHAR), ',' ORDER BY pivot_id) AS ranks FROM pre GROUP BY id"
    out["napp_postings"] = f"WITH {_P}, {_PIVOTS} SELECT pivot_id, count(*) AS points FROM pre WHERE place <= {PREFIX} GROUP BY pivot_id"
    out["napp_knn"] = f"WITH {_P}, {_PIVOTS}, c AS (SELECT y.id AS query_id, x.id FROM pre x JOIN pre y ON x.pivot_id = y.pivot_id WHERE x.place <= {PREFIX} AND y.place <= {PREFIX} AND y.id % {EVERY} = 0 GROUP BY ALL HAVING count(*) >= 2), d AS (SELECT c.query_id, c.id, sqrt(list_sum(list_transform(list_zip(p.v, o.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist FROM c JOIN p ON p.id = c.id JOIN p o ON o.id = c.query_id) {_TOP}"
    sets = f"WITH b AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT id, {SETS[1]} AS v FROM b)"
    out["overlap2"] = f"{sets} SELECT x.id AS a, y.id AS b, CAST(len(list_intersect(x.v, y.v)) AS INTEGER) AS shared FROM p x JOIN p y ON y.id = x.id + 1"
    out["overlap3"] = f"{sets} SELECT x.id AS a, y.id AS b, w.id AS c, CAST(len(list_intersect(list_intersect(x.v, y.v), w.v)) AS INTEGER) AS shared FROM p x JOIN p y ON y.id = x.id + 1 JOIN p w ON w.id = x.id + 2"
    out["overlap_info"] = _overlap_info_sql()
    out["gold_standard"] = f"WITH {_GOLD} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(dist, 6) AS dist FROM g"
    same = f"{ev.SAME!r}"
    out["recall"] = f"WITH {_GOLD}, k AS (SELECT query_id, dist AS kth FROM g WHERE rank = {K}), x AS (SELECT g.* FROM g JOIN k USING (query_id) WHERE rank <= {K} OR dist <= kth + abs(kth) * {same}) SELECT x.query_id, round(least(1.0, count(a.id)::DOUBLE / least(count(*), {K})), 6) AS recall FROM x LEFT JOIN a ON a.query_id = x.query_id AND a.id = x.id GROUP BY x.query_id"
    closer = f"WITH {_GOLD}, m AS (SELECT query_id, min(dist) AS best FROM a GROUP BY query_id) SELECT query_id, count(CASE WHEN dist < best - abs(best) * {same} THEN 1 END) AS num_closer FROM g JOIN m USING (query_id) GROUP BY query_id"
    out["num_closer"] = closer
    out["recall_at_1"] = f"SELECT query_id, CAST(num_closer < 1 AS INTEGER) AS recall_at_1 FROM ({closer})"
    placed = f"WITH {_GOLD}, r AS (SELECT a.query_id, a.rank AS i, g.rank AS pos FROM a JOIN g ON a.query_id = g.query_id AND a.id = g.id)"
    out["precision_of_approx"] = f"{placed} SELECT query_id, round(avg(i::DOUBLE / pos), 6) AS precision_of_approx FROM r GROUP BY query_id"
    out["rel_pos_error"] = f"{placed} SELECT query_id, round(exp(avg(ln(pos::DOUBLE / i))), 6) AS rel_pos_error FROM r GROUP BY query_id"
    out["metric_summary"] = f"SELECT round(avg(recall), 6) AS mean, round(1.96 * stddev_samp(recall) / sqrt(count(*)), 6) AS half_width FROM ({out['recall']})"
    votes = f"WITH {_base('v').replace('{}', l2)}, n AS (SELECT query_id, id FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, id) <= {K}), c AS (SELECT query_id, label, count(*) AS votes FROM n JOIN p USING (id) GROUP BY ALL)"
    out["knn_classify"] = f"{votes} SELECT query_id, label, votes FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) = 1"
    out["class_accuracy"] = f"{votes}, w AS (SELECT query_id, label FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) = 1) SELECT round(avg(CASE WHEN w.label = p.label THEN 1.0 ELSE 0.0 END), 6) AS class_accuracy FROM w JOIN p ON p.id = w.query_id"
    out["bootstrap_split"] = "SELECT split, points FROM (SELECT CAST(i AS INTEGER) AS split, CAST(20 AS BIGINT) AS points FROM range(0, 3) r(i) UNION ALL SELECT -1, count(*) - 60 FROM embeddings)"
    every = f"SELECT count(*) AS queries, TRUE AS reached FROM embeddings WHERE vec_id % {EVERY} = 0"
    out |= {"hnsw_recall": every, "swgraph_recall": every, "graph_add_delete_knn": every.replace("reached", "reached, CAST(0 AS BIGINT) AS deleted_found")}
    out |= {"graph_nodes": "SELECT vec_id AS id FROM embeddings", "graph_delete": "SELECT vec_id AS id FROM embeddings WHERE vec_id % 10 <> 3", "improvement": "SELECT TRUE AS saves"}
    out["pivot_distances"] = f"WITH {_P}, {_PIVOTS} SELECT id, pivot_id, round(dist, 6) AS dist FROM tp"
    out["binarized"] = f"SELECT vec_id AS id, {PIVOTS // 2} AS ones FROM embeddings"
    out["intrinsic_dim"] = f"WITH {_P}, d AS (SELECT sqrt(list_sum(list_transform(list_zip(x.v, y.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM p x JOIN p y ON y.id = x.id + 1) SELECT round(pow(avg(d), 2) / (2 * var_pop(d)), 4) AS intrinsic_dim FROM d"
    long = lambda v, n=64: f"WITH {_P}, t AS (SELECT id, {v} AS v FROM p), u AS (SELECT id, unnest(range(0, {n})) AS pos, unnest(v) AS x FROM t) SELECT id, CAST(pos AS INTEGER) AS pos, round(x + 0.0, 6) AS val FROM u"
    out["normalize"] = long("list_transform(v, lambda x: 3 * x / sqrt(list_sum(list_transform(v, lambda y: 9 * y * y))))")
    out["center"] = f"WITH {_P}, u AS (SELECT id, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM p) SELECT id, CAST(pos AS INTEGER) AS pos, round(x - avg(x) OVER (PARTITION BY pos) + 0.0, 6) AS val FROM u"
    out["mean_vector"] = f"WITH {_P}, u AS (SELECT label, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM p) SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS mean FROM u GROUP BY ALL"
    out["bregman_mean"] = f"WITH {_P}, t AS (SELECT {DISTRIBUTION[1]} AS v FROM p), u AS (SELECT unnest(range(0, 64)) AS pos, unnest(v) AS x FROM t) SELECT CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS mean FROM u GROUP BY ALL"
    out["bregman_gradient"] = long(f"list_transform({DISTRIBUTION[1]}, lambda w: ln(w) + 1)")
    out["projection"] = long("v[1:8]", 8)
    inner = _each("#x * #y")
    terms = f"list_sum(list_transform(list_zip(v, q), lambda z: CASE WHEN abs(z[1]) > 0.15 AND abs(z[2]) > 0.15 THEN z[1] * z[2] ELSE 0.0 END))"
    out["fusion_negdot"] = _knn_sql("v", f"-(0.7 * {terms} + 0.3 * {inner})")
    out |= {"sqfd_minus": _sqfd_sql("-#d"), "sqfd_heuristic": _sqfd_sql("1 / (1.0 + #d)"), "sqfd_gaussian": _sqfd_sql("exp(-(#d * #d))")}
    return out


__all__ = ["oracle_sql", "queries", "top_k"]
