"""The package's own code in the executors' Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers, once per application: Spark serves the driver's file to the executors."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="feedloom-code-")
    root = os.path.join(folder, "root")
    shutil.copytree(package, os.path.join(root, os.path.basename(package)), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(folder, "feedloom_engine"), "zip", root))
    _SHIPPED.add(context.applicationId)
