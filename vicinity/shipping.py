"""Makes this package importable for Python workers, wherever they run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands the package's sources to Spark once for each application; executors fetch them from the driver."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = Path(__file__).resolve().parent
    made = tempfile.mkdtemp(prefix="vicinity-")  # read by the driver alone, which serves it
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    staged = Path(made) / "staged"
    shutil.copytree(here, staged / here.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{made}/vicinity", "zip", staged))
