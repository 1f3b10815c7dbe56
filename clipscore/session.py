"""Make the package importable in Python workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application.

    Arrow tasks import it, and the driver's module path does not reach the workers.  The archive is
    written locally and served by the driver, so executors that join later get it too.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="spark-")) / root.name
    archive = shutil.make_archive(str(base), "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
