"""Puts this package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Once for each application: executors then need no copy of the repository."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="vellum-"), "vellum.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
        _sent.add(app)
    return spark
