"""Sessions for local runs, and the package on the executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

# Whole documents are long rows, so fewer of them go into one Arrow batch than by default.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_ready: set[str] = set()


def local_session(name: str, cores: int | str = "*", partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        # Small single files are read by several tasks.
        .config("spark.sql.files.maxPartitionBytes", "1m")
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> None:
    """Once per application: send this package to the executors and bound the Arrow batches.

    A job submitted with ``--py-files`` has the package there already; sending it again is
    harmless. A batch size in the application's own configuration is left alone, whatever it
    is; one that is set after this call holds from then on.
    """
    app = spark.sparkContext.applicationId
    if app in _ready:
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='sheafwork-')}/sheafwork", "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(archive)
    if not spark.sparkContext.getConf().contains(_BATCH_SETTING):
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    _ready.add(app)
