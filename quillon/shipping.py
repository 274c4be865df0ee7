"""Make this package importable on the executors of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()

#: Rows of an Arrow batch: whole texts make rows large, and a worker holds several copies of its batch.
BATCH_ROWS, USUAL_ROWS = "1000", "10000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of an Arrow batch: pairs of long texts reach Spark's own limit long before a thousand rows.
BATCH_BYTES, USUAL_BYTES = "8m", "67108864b"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application; keep batches small where nothing else is set."""
    context = spark.sparkContext
    if spark.conf.get(_BATCH) == USUAL_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)
    if spark.conf.get(_BYTES, USUAL_BYTES) == USUAL_BYTES:
        spark.conf.set(_BYTES, BATCH_BYTES)
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    at = os.path.join(tempfile.mkdtemp(prefix="quillon-ship-"), "quillon_src.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(at)
    _SHIPPED.add(context.applicationId)
