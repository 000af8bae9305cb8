"""Sending the package to executors whose Python path lacks it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's source to the session once, unless PYTHONPATH, which workers inherit, has it."""
    context = spark.sparkContext
    on_path = _ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if on_path or context.applicationId in _done:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="graphloom-src-"), "graphloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(os.path.join(_ROOT, "graphloom")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, _ROOT))
    context.addPyFile(path)
    _done.add(context.applicationId)
