"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings every job wants; none of them depends on the size of the cluster.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join input even where that costs one more shuffle afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


# What has been done for an application already: shipped packages, and the fallback work folder.
_shipped: set[str] = set()
_fallback: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and make the package known to its Python workers."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "tablemill")
    context.addPyFile(shutil.make_archive(base, "zip", root, "tablemill"))
    _shipped.add(context.applicationId)


def local_session(cpus: str = "8", name: str = "tablemill") -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TABLEMILL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.local.dir", scratch)
        .config("spark.checkpoint.dir", scratch + "/shared")
        .config("spark.sql.warehouse.dir", scratch + "/warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it in ``spark.checkpoint.dir``.

    A temporary local folder is used only where the setting is absent, that is on one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("WORK_DIR_REQUIRED: set spark.checkpoint.dir to a folder shared by all executors.")
        application = spark.sparkContext.applicationId
        if application not in _fallback:
            _fallback[application] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        folder = _fallback[application]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
