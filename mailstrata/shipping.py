"""Sends this package to the executors, so that Python functions in it run wherever Spark does."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """spark, whose executors have this package on their path from now on; done once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="mailstrata-")) / f"{root.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(path))
        _sent.add(context.applicationId)
    return spark
