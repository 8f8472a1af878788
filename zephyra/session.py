"""Spark session settings the operators rely on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
}

_shipped: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that someone else built, and send it this package."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application. Functions that run in Python workers are pickled by the
    name of their module, and the working folder of a worker need not be the one with the package."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    # Spark serves the driver's copy of the file to the executors, so it need not lie in a shared folder
    archive = Path(tempfile.mkdtemp(prefix="zephyra-")) / "zephyra.zip"
    with zipfile.ZipFile(archive, "w") as made:
        for file in sorted(package.rglob("*.py")):
            made.write(file, Path(package.name) / file.relative_to(package))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("zephyra")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables, as ``spark.checkpoint.dir`` names it.

    Only a session without that setting, such as a local test, gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="zephyra-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder
