"""Make the package importable on executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _DONE:
        return spark
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
        if (top := root.parent / "corpus_pipeline.py").exists():
            z.write(top, top.name)
    folder = tempfile.mkdtemp(prefix="mosaiq-src-")
    path = os.path.join(folder, "mosaiq_src.zip")
    Path(path).write_bytes(held.getvalue())
    sc.addPyFile(path)
    _DONE.add(sc.applicationId)
    return spark
