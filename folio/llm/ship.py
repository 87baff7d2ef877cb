"""Send this package to the executors, which import it in their Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()

#: Rows and bytes of an Arrow batch, unless the session has its own: texts may be long, and a worker holds a batch several times.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship(spark: SparkSession) -> None:
    """Add the package to the application once, as ``--py-files`` would, and bound the batches that its workers get."""
    own = spark.conf.getAll
    for name, value in BATCH.items():
        if name not in own:
            spark.conf.set(name, value)
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parents[2]
    path = Path(tempfile.mkdtemp(prefix="folio-")) / "folio.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted((root / "folio").rglob("*.py")):
            z.write(file, file.relative_to(root))
    context.addPyFile(str(path.resolve()))
    _sent.add(context.applicationId)
