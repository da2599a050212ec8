"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


#: Bytes of one Arrow batch between the JVM and Python; Spark's own 64 MB are held several times over.
ARROW_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def ship(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers, wherever the driver was started.

    Arrow batches are made small unless the session has its own setting."""
    if spark.conf.get(ARROW_BATCH[0], None) is None:
        spark.conf.set(*ARROW_BATCH)
    context = spark.sparkContext
    if getattr(context, "_tremor_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="tremor-"))  # executors fetch it from the driver later
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "tremor_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, names in sorted(os.walk(top)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.join("tremor", os.path.relpath(full, top)))
    context.addPyFile(path)
    context._tremor_shipped = True
