"""Session for local runs, and the shared folder a job may write to."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, name: str = "stockflow", **conf: str) -> SparkSession:
    """A single-machine session for tests and benches; a cluster brings its own."""
    parallelism = "8" if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", parallelism)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else one below the warehouse.

    A warehouse on the driver's machine serves a local session only.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    on_machine = warehouse.startswith("file:") or "://" not in warehouse
    if on_machine and not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse}/staged"


def run_dir(spark: SparkSession) -> str:
    """The folder of this application within the shared one; everything it stages is below it."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the folder of this application that nothing else uses."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_run_dir(spark: SparkSession) -> None:
    """Delete what this application has staged, once no result is read from it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
