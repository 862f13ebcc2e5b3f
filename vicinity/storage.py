"""Tables that an index keeps: written under a folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; on one machine (a local master) one is made where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _made:
        _made[key] = tempfile.mkdtemp(prefix="vicinity-")
        atexit.register(shutil.rmtree, _made[key], ignore_errors=True)
    return _made[key]


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The table, written as Parquet (under ``path``, else in a new folder of the shared one) and read again."""
    path = f"{path}/{name}" if path else f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
