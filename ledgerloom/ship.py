"""Give executors the package: their Python workers import it by name, and need not share the driver's working directory."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session once."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    here = Path(__file__).resolve().parent
    if not here.is_dir():  # imported from an archive that was shipped already
        return
    folder = tempfile.mkdtemp(prefix="ledgerloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/ledgerloom_sources.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(here.rglob("*.py")):
            z.write(path, f"{here.name}/{path.relative_to(here)}")
    context.addPyFile(archive)
