"""Sends the package to executors that may not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session as a zip file, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    path = os.path.join(tempfile.mkdtemp(), f"{_PACKAGE.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    context.addPyFile(path)
    _done.add(context.applicationId)
