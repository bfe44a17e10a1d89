"""Send the package's source to the executors, so that what they unpickle can be imported there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ensure_importable(spark: SparkSession) -> None:
    """Add a zip of the sources to the application, once; executors fetch it from the driver."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parent
    file = Path(tempfile.mkdtemp(prefix="veldra-")) / "veldra_sources.zip"
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
        for path in root.parent.glob("corpus_pipeline.py"):
            z.write(path, path.name)
    context.addPyFile(str(file))
    _SENT.add(context.applicationId)
