"""Session settings and lineage cutting shared by every job."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = 8, name: str = "tallyforge", **extra: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    conf = {
        **SETTINGS,
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("TALLYFORGE_DRIVER_MEMORY", "8g"),
        "spark.sql.shuffle.partitions": "8",
        **extra,
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names. Only a local session gets one of its own, where none is named."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tallyforge-checkpoint-"))
    return df.checkpoint()


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share. Files there belong to one run; the cluster expires them."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tallyforge-files-")
    return f"{folder.rstrip('/')}/tallyforge/{name}-{uuid.uuid4().hex}"
