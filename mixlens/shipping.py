"""Making the package importable on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors this package, so that Python workers import it by name."""
    context = spark.sparkContext
    if getattr(context, "_mixlens_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="mixlens-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "mixlens.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted([*package.rglob("*.py"), *package.rglob("*.json")]):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    context._mixlens_shipped = True
