"""Python workers: the library is sent to them once for each application, wherever it is installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import lexivec


def ship(spark: SparkSession) -> None:
    """Before a plan whose Python functions use the library's own classes."""
    context = spark.sparkContext
    if getattr(context, "_lexivec_shipped", False):
        return
    root = Path(lexivec.__file__).parent
    folder = tempfile.mkdtemp(prefix="lexivec-")  # on the driver, which serves the file to executors as they come
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/lexivec-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(archive)
    context._lexivec_shipped = True
