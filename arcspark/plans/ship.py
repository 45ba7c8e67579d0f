"""Make the package importable for Python workers that weren't started with its folder on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: send the package's sources to the executors if workers can't see them.

    Workers see them where the repository is on PYTHONPATH or is the working directory.
    """
    application = spark.sparkContext.applicationId
    seen = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if application in _SHIPPED or str(ROOT) in seen or Path.cwd().resolve() == ROOT:
        return
    archive = Path(tempfile.mkdtemp()) / "arcspark_sources.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((ROOT / "arcspark").rglob("*.py")):
            out.write(path, path.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(application)
