"""Gold standards and the metrics that compare approximate results with them.

Exact and approximate results are (query_id, rank, id, dist). A gold standard keeps more than k rows, and an exact
answer set also has what ties with the k-th.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distances import distance
from .knn import search

#: How many times k a gold standard keeps.
DEPTH = 10
#: Distances within this relative difference are equal: four units in the last place of a float.
SAME = 4 * 2.0**-23


def gold_standard(points: DataFrame, queries: DataFrame, k: int, dist: str = "l2", payload: str = "vec", depth: int = DEPTH, **params) -> DataFrame:
    return search(points, queries, k * depth, dist, payload, params)


def cached_gold(gold: DataFrame, path: str | None) -> DataFrame:
    """A gold standard kept under ``path``: computed and written once, read from then on."""
    if path is None:
        return gold
    spark = gold.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        gold.write.mode("overwrite").parquet(path)
    return spark.read.schema(gold.schema).parquet(path)


def exact_set(gold: DataFrame, k: int) -> DataFrame:
    """The first k of each query and what ties with the last of them."""
    kth = gold.where(F.col("rank") == k).select("query_id", F.col("dist").alias("_kth"))
    return gold.join(kth, "query_id", "left").where((F.col("rank") <= k) | (F.col("dist") <= F.col("_kth") + F.abs("_kth") * SAME)).drop("_kth")


def recall(gold: DataFrame, approx: DataFrame, k: int) -> DataFrame:
    """Share of the exact answers found: (query_id, recall); 1 where there are none."""
    exact = exact_set(gold, k)
    hits = exact.join(approx.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    size = exact.groupBy("query_id").agg(F.least(F.count("*"), F.lit(k)).alias("size"))
    return size.join(hits, "query_id", "left").select("query_id", F.least(F.lit(1.0), F.coalesce("hits", F.lit(0)) / F.col("size")).alias("recall"))


def recall_in_range(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """Share of the points in range found: (query_id, recall), for queries that have any."""
    hits = exact.join(approx.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    return exact.groupBy("query_id").agg(F.count("*").alias("size")).join(hits, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.col("size")).alias("recall"))


def num_closer(gold: DataFrame, approx: DataFrame) -> DataFrame:
    """Exact points strictly closer than the best point returned: (query_id, num_closer)."""
    best = approx.groupBy("query_id").agg(F.min("dist").alias("_best"))
    return gold.join(best, "query_id", "left").groupBy("query_id").agg(F.count(F.when(F.col("_best").isNull() | (F.col("dist") < F.col("_best") - F.abs("_best") * SAME), 1)).alias("num_closer"))


def recall_at_1(closer: DataFrame) -> DataFrame:
    return closer.select("query_id", (F.col("num_closer") < 1).cast("int").alias("recall_at_1"))


def _positions(gold: DataFrame, approx: DataFrame) -> DataFrame:
    """Rank of each answer among the answers (i) and in the exact list (pos)."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id"))
    return approx.withColumn("i", place).join(gold.select("query_id", "id", F.col("rank").alias("pos")), ["query_id", "id"])


def precision_of_approx(gold: DataFrame, approx: DataFrame) -> DataFrame:
    """Mean of i / pos over the answers."""
    return _positions(gold, approx).groupBy("query_id").agg(F.avg(F.col("i") / F.col("pos")).alias("precision_of_approx"))


def rel_pos_error(gold: DataFrame, approx: DataFrame) -> DataFrame:
    """Geometric mean of pos / i over the answers."""
    return _positions(gold, approx).groupBy("query_id").agg(F.exp(F.avg(F.ln(F.col("pos") / F.col("i")))).alias("rel_pos_error"))


def class_accuracy(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of queries whose voted label is theirs."""
    return predicted.join(truth.select("query_id", F.col("label").alias("_t")), "query_id").agg(F.avg((F.col("label") == F.col("_t")).cast("double")).alias("class_accuracy"))


def summary(values: DataFrame, column: str) -> DataFrame:
    """Mean of a metric and the half width of its 95 % interval."""
    return values.agg(F.avg(column).alias("mean"), (1.96 * F.coalesce(F.stddev_samp(column), F.lit(0.0)) / F.sqrt(F.count(column))).alias("half_width"))


def improvement(n_points: int, computed: DataFrame) -> DataFrame:
    """How many times fewer distances than a scan: ``computed`` has (query_id, n)."""
    return computed.agg((F.lit(float(n_points)) / F.avg("n")).alias("impr_dist_comp"))


def bootstrap_split(points: DataFrame, sets: int, size: int, seed: int = 0) -> DataFrame:
    """Marks disjoint random query sets (``split`` 0..sets-1); the rest is the index (``split`` -1)."""
    if points.count() < (sets + 1) * size:
        raise ValueError("too few points for the query sets")
    chosen = points.select("id").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sets * size)
    placed = chosen.withColumn("_n", F.row_number().over(Window.orderBy(F.xxhash64("id", F.lit(seed)), "id")) - 1)  # sets * size rows
    return points.join(placed.select("id", F.floor(F.col("_n") / size).cast("int").alias("_s")), "id", "left").withColumn("split", F.coalesce("_s", F.lit(-1))).drop("_s")


def intrinsic_dimensionality(points: DataFrame, dist: str = "l2", payload: str = "vec", partners: int = 3, **params) -> DataFrame:
    """mean^2 / (2 variance) of distances of hashed pairs: every point with a partner in each of some random orders."""
    f = distance(dist, **params)
    rows = points.select("id", F.col(payload).alias("_v"), F.explode(F.sequence(F.lit(1), F.lit(partners))).alias("_r"))
    # pairs meet in small random buckets, so no global order is needed
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64("id", "_r"), F.greatest(F.lit(1), F.lit(points.count() // 16))))
    order = Window.partitionBy("_r", "_b").orderBy(F.xxhash64("id", "_r", F.lit(1)))
    paired = dealt.withColumn("_q", F.lead("_v").over(order)).where(F.col("_q").isNotNull())
    return paired.select(f(F.col("_v"), F.col("_q")).alias("d")).agg((F.pow(F.avg("d"), F.lit(2)) / (2 * F.var_pop("d"))).alias("intrinsic_dim"))
