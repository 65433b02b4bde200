"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Rows of an Arrow batch: of Spark's default of 10,000 long texts, each task would hold several copies.
BATCH_ROWS = "1000"


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each context, so that Python tasks can import it anywhere, and bounds
    Arrow batches where the session hasn't done so."""
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if not getattr(context, "_nullgauge_shipped", False):
        package = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="nullgauge-"), "nullgauge.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(package.rglob("*.py")):
                z.write(path, path.relative_to(package.parent))
        context.addPyFile(target)
        context._nullgauge_shipped = True
    return spark
