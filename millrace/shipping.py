"""Gives executors this package, so that a session needs no deployment step of its own."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of a batch between the JVM and Python, where the session doesn't say: a batch counts
#: rows otherwise, and 10,000 very long texts don't fit a worker.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application once; executors fetch them from the driver.

    Bounds the session's Arrow batches by bytes, unless it has a bound of its own.
    """
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
        for p in sorted(root.parent.glob("*_pipeline.py")):
            z.write(p, p.name)
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
