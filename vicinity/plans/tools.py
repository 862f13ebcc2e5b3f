"""Two tools of an evaluation: the partition search tuned for a recall, and the throughput of distances.

    python -m vicinity.plans.tools tune --points points.parquet --space l2 --knn 10 --desiredRecall 0.9
    python -m vicinity.plans.tools distances --dim 128 --rows 20000 l1 l2 cosinesimil
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import is_matrix
from ..operators.evaluation import bootstrap_split
from ..operators.knn import search, search_range
from ..operators.vptree import VPTree, tune


def tune_vptree(points: DataFrame, space: str, k: int | None, desired: float, radius: float | None = None, queries: int = 50, bucket: int = 50, exps: tuple[float, ...] = (1.0,), payload: str = "vec", **params) -> dict:
    """The pruner with the fewest distances for the desired recall, over queries that are taken out of the points."""
    split = bootstrap_split(points, 1, queries)
    base, asked = split.where("split <> 0").drop("split"), split.where("split = 0").select(F.col("id").alias("query_id"), payload)
    index = VPTree.build(base.select("id", payload), space, payload, bucket, **params)
    gold = search(base, asked, 10 * k, space, payload, params) if radius is None else search_range(base, asked, radius, space, payload, params)
    pruner, recall, n = tune(index, asked, gold, k or 0, desired, exps=exps, radius=radius)
    return {"alphaLeft": pruner.alpha_left, "alphaRight": pruner.alpha_right, "expLeft": pruner.exp_left, "expRight": pruner.exp_right, "recall": recall, "impr_dist_comp": base.count() / n if n else None}


def distance_rates(spark: SparkSession, spaces: list[str], dim: int = 128, rows: int = 20_000, queries: int = 200, seed: int = 0) -> DataFrame:
    """Distances a second and core of dense spaces, as a scan of random positive vectors has them: (space, per_second_and_core)."""
    random = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.abs(F.xxhash64("id", i, F.lit(seed)) % 1_000_003) / 1_000_003.0 + 1e-3)
    points = spark.range(rows).withColumn("vec", random).cache()
    points.count()
    asked = points.where(F.col("id") < queries).select(F.col("id").alias("query_id"), "vec").cache()
    out = []
    for name in spaces:
        if not is_matrix(name):
            raise ValueError(f"space {name!r} takes no plain vectors")
        took = []
        for _ in range(2):
            began = time.perf_counter()
            search(points, asked, 1, name).count()
            took.append(time.perf_counter() - began)
        out.append((name, rows * queries / min(took) / spark.sparkContext.defaultParallelism))
    points.unpersist()
    asked.unpersist()
    return spark.createDataFrame(out, "space string, per_second_and_core double")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    of = p.add_subparsers(dest="tool", required=True)
    t = of.add_parser("tune")
    t.add_argument("--points", required=True)
    t.add_argument("--space", required=True)
    t.add_argument("--knn", type=int)
    t.add_argument("--range", type=float)
    t.add_argument("--desiredRecall", type=float, default=0.9)
    t.add_argument("--maxNumQuery", type=int, default=50)
    t.add_argument("--bucketSize", type=int, default=50)
    t.add_argument("--maxExp", type=int, default=1)
    d = of.add_parser("distances")
    d.add_argument("spaces", nargs="+")
    d.add_argument("--dim", type=int, default=128)
    d.add_argument("--rows", type=int, default=20_000)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.tool == "tune":
        if (a.knn is None) == (a.range is None):
            p.error("give one of --knn and --range")
        print(tune_vptree(spark.read.parquet(a.points), a.space, a.knn, a.desiredRecall, a.range, a.maxNumQuery, a.bucketSize, tuple(float(e) for e in range(1, a.maxExp + 1))))
    else:
        distance_rates(spark, a.spaces, a.dim, a.rows).show(truncate=False)


if __name__ == "__main__":
    main()
