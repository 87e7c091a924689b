"""Makes the package importable for the Python workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Archives that executors fetch from the driver, kept as long as it runs.
_served: list[tempfile.TemporaryDirectory] = []


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors, for sessions that were started without it.

    Not needed where the wheel is installed on every machine or given with ``--py-files``.
    """
    root = Path(__file__).resolve().parent
    folder = tempfile.TemporaryDirectory(prefix="package-")
    _served.append(folder)
    target = Path(folder.name, f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
