"""Puts this package on the executors: tasks import it there, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application: the package's modules as a zip that Spark serves to every executor."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    if context.applicationId in _shipped or not package.is_dir():
        return
    _shipped.add(context.applicationId)
    at = os.path.join(tempfile.mkdtemp(prefix="skein-package-"), "skein-package.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(at)
