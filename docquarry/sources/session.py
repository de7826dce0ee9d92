"""What a running session needs: the package on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, unless they find it on their path anyway."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or Path.cwd() == root:
        return
    _shipped.add(app)
    target = Path(tempfile.mkdtemp(prefix="docquarry-")) / "docquarry.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "docquarry").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
