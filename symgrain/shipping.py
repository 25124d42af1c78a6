"""Makes this package importable on executors."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once, unless PYTHONPATH, which workers inherit, already leads to it."""
    context = spark.sparkContext
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _PACKAGE.parent in paths or getattr(context, "_symgrain_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="symgrain-")) / "symgrain.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(_PACKAGE.rglob("*.py")):
            out.write(file, file.relative_to(_PACKAGE.parent))
    context.addPyFile(str(archive))
    context._symgrain_shipped = True


def shipped(f: Callable) -> Callable:
    """f(spark, ...), after ship(spark)."""

    @functools.wraps(f)
    def run(spark: SparkSession, *rest):
        ship(spark)
        return f(spark, *rest)

    return run
