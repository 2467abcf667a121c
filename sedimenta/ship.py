"""Gets this package to the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


#: Rows that go to a Python worker at once, unless the session says otherwise: texts can be long.
ARROW_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's files, once a session, so that workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark.sparkContext.getConf().contains(rows) and spark.conf.get(rows) == "10000":
        spark.conf.set(rows, ARROW_ROWS)
    root = Path(__file__).resolve().parent
    fd, path = tempfile.mkstemp(prefix=f"{root.name}-", suffix=".zip")  # the driver serves it; workers fetch it from there
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
