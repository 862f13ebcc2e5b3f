"""Runs a method against the exact answers over bootstrap query sets, and reports its metrics.

    python -m vicinity.plans.experiment --points points.parquet --space l2 --method hnsw --knn 10 \\
        --createIndex M=16 --queryTimeParams ef=20 --queryTimeParams ef=60 --output report

Queries are drawn from the points, or come from a file of their own (``--queryFile``, Parquet with query_id). With
``--range`` the answers are all points within a radius, judged by the share that was found.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distances import distance
from ..operators import evaluation as ev
from ..operators.knn import classify, search, search_range
from .session import init, parameters

COLUMNS = "method string, params string, knn int, recall double, recall_ci double, recall_at_1 double, num_closer double, precision_of_approx double, rel_pos_error double, class_accuracy double, queries_per_second double, improvement_in_time double"


def run(spark: SparkSession, points: DataFrame, space: str, method: str, k: int, space_params=None, index_params=None, query_params: list | None = None, sets: int = 1, queries: int = 20, cache: str | None = None, payload: str = "vec", data_type: str = "DENSE_VECTOR", asked: DataFrame | None = None, radius: float | None = None, eps: float = 0.0, recall_only: bool = False) -> DataFrame:
    """One row for each set of query-time parameters, over ``sets`` disjoint query sets of ``queries`` points, or over
    the queries ``asked``. ``recall_only`` leaves the other metrics null; ``eps`` is the slack of a partition search."""
    split = ev.bootstrap_split(points, sets, queries) if asked is None else points.withColumn("split", F.lit(-1))
    given = parameters(space_params)
    distance(space, **given)
    rows: dict[str, list[dict]] = {}
    for s in range(sets if asked is None else 1):
        base = split.where(F.col("split") != s).drop("split")
        own = split.where(F.col("split") == s).select(F.col("id").alias("query_id"), payload) if asked is None else asked
        n = queries if asked is None else asked.count()
        began = time.perf_counter()
        exact = search_range(base, own, radius, space, payload, given) if radius is not None else search(base, own, k * ev.DEPTH, space, payload, given)
        gold = ev.cached_gold(exact, f"{cache}/{space}-{k if radius is None else f'r{radius}'}-{s}" if cache else None).cache()
        gold.count()
        whole = time.perf_counter() - began
        index = init(spark, space, given, method, data_type, payload=payload)
        index.addDataPointBatch(base.select("id", payload))
        index.createIndex(index_params)
        for params in query_params or [None]:
            index.setQueryTimeParams(params)
            began = time.perf_counter()
            if radius is not None:
                found = index.rangeQueryBatch(own, radius).cache()
            elif eps and method == "vptree":
                found = index.built.knn(own, k, index._pruner(), index.query_params["maxLeavesToVisit"], eps).cache()
            else:
                found = index.knnQueryBatch(own, k).cache()
            found.count()
            took = time.perf_counter() - began
            mean = lambda df, c: df.agg(F.avg(c)).first()[0]
            got = dict.fromkeys(("recall_at_1", "num_closer", "precision_of_approx", "rel_pos_error", "class_accuracy"))
            if radius is not None:
                got["recall"] = mean(ev.recall_in_range(gold, found), "recall")
            else:
                got["recall"] = mean(ev.recall(gold, found, k), "recall")
            if radius is None and not recall_only:
                closer = ev.num_closer(gold, found)
                got |= {"recall_at_1": mean(ev.recall_at_1(closer), "recall_at_1"), "num_closer": mean(closer, "num_closer"), "precision_of_approx": mean(ev.precision_of_approx(gold, found), "precision_of_approx"), "rel_pos_error": mean(ev.rel_pos_error(gold, found), "rel_pos_error")}
                if "label" in points.columns and asked is None:
                    truth = split.where(F.col("split") == s).select(F.col("id").alias("query_id"), "label")
                    got["class_accuracy"] = ev.class_accuracy(classify(found, base), truth).first()[0]
            rows.setdefault(str(parameters(params)), []).append({**got, "queries_per_second": n / took, "improvement_in_time": whole / took})
            found.unpersist()
        gold.unpersist()
    out = []
    for params, got in rows.items():
        avg = lambda c: None if got[0][c] is None else sum(x[c] for x in got) / len(got)  # noqa: B023, E731
        spread = (sum((x["recall"] - avg("recall")) ** 2 for x in got) / max(1, len(got) - 1)) ** 0.5
        out.append((method, params, k, avg("recall"), 1.96 * spread / len(got) ** 0.5, *(avg(c) for c in ("recall_at_1", "num_closer", "precision_of_approx", "rel_pos_error", "class_accuracy", "queries_per_second", "improvement_in_time"))))
    return spark.createDataFrame(out, COLUMNS)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("points", "space", "method"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--knn", type=int, default=10)
    p.add_argument("--range", type=float)
    p.add_argument("--eps", type=float, default=0.0)
    p.add_argument("--queryFile")
    p.add_argument("--recallOnly", action="store_true")
    p.add_argument("--spaceParams", nargs="*", default=[])
    p.add_argument("--createIndex", nargs="*", default=[])
    p.add_argument("--queryTimeParams", action="append", nargs="*", default=[])
    p.add_argument("--testSetQty", type=int, default=1)
    p.add_argument("--maxNumQuery", type=int, default=20)
    p.add_argument("--maxNumData", type=int)
    p.add_argument("--cachePrefixGS")
    p.add_argument("--dataType", default="DENSE_VECTOR")
    p.add_argument("--output")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    points = spark.read.parquet(a.points)
    if a.maxNumData:
        points = points.orderBy("id").limit(a.maxNumData)
    report = run(spark, points, a.space, a.method, a.knn, a.spaceParams, a.createIndex, a.queryTimeParams or None, a.testSetQty, a.maxNumQuery, a.cachePrefixGS, data_type=a.dataType, asked=spark.read.parquet(a.queryFile) if a.queryFile else None, radius=a.range, eps=a.eps, recall_only=a.recallOnly)
    if a.output:
        from ..sources.text import write_report

        write_report(report, a.output)
    else:
        report.show(truncate=False)


if __name__ == "__main__":
    main()
