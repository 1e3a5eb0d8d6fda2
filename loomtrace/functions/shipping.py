"""Getting this package to executors that do not have it installed."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Adds a zip of the package to the application, once, unless PYTHONPATH has it."""
    context = spark.sparkContext
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(_ROOT) in on_path or context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="spark-package-")
    name = Path(__file__).resolve().parents[1].name
    context.addPyFile(shutil.make_archive(f"{folder}/{name}", "zip", _ROOT, name))
    _shipped.add(context.applicationId)
