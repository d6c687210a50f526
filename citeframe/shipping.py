"""Send this package to the executors, whose Python workers may not have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add a zip of the package to the session's files, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_citeframe_shipped", False):
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="citeframe-"), "citeframe.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(path)
    sc._citeframe_shipped = True
