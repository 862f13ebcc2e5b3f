"""Points that arrive as a stream, and queries that do.

New points are appended by micro-batch (idempotently, by batch id); deletions are kept as a table of ids. Queries
of a stream meet the stored points as a static side: a stateless stream-static join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.knn import search


def append_points(stream: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Starts to store arriving points (id, payload) under ``path``, one folder a micro-batch; a repeated batch replaces
    itself. ``once``: stops when all that is there now is stored."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def stored_points(spark: SparkSession, path: str, deleted: DataFrame | None = None) -> DataFrame:
    """All points so far: the latest of each id, without the deleted ones."""
    rows = spark.read.parquet(path)
    latest = rows.groupBy("id").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("id", "batch"))), "batch").alias("_p")).select("id", "_p.*")
    return latest if deleted is None else latest.join(deleted.select("id"), "id", "left_anti")


def answer_stream(queries: DataFrame, points: DataFrame, k: int, sink: str, checkpoint: str, dist: str = "l2", payload: str = "vec"):
    """Starts to answer arriving queries; each micro-batch's answers are appended under ``sink``."""

    def answer(batch: DataFrame, number: int) -> None:
        search(points, batch, k, dist, payload).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).start()
