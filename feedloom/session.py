"""Session settings and lineage cutting."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def local_session(cores: int | str = 8, *, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("feedloom")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Without it a session whose executor is the driver itself gets a folder of its own, which goes with the process; any
    other session has to name one.
    """
    global _local_folder
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that driver and executors share.")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="feedloom-")
        atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
    return _local_folder


_local_folder: str | None = None


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back.

    Cuts the lineage, survives lost executors, and later passes read only the columns they need.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/feedloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
