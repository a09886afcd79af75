"""Session settings, and the package's code on executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session as the tests and the bench use it; a cluster brings its own master, memory and partition counts."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = builder.config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.driver.memory", os.environ.get("PITLANE_DRIVER_MEMORY", "6g")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_code(spark: SparkSession) -> None:
    """Send this package to the application's executors, so functions that run there can import it."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="pitlane-code-")  # the driver serves the file from here as long as it runs
    atexit.register(shutil.rmtree, folder, True)
    path = Path(folder, "pitlane_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _sent.add(app)
