"""Shared folder for reliable checkpoints and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from faultline.errors import ConfigError

SETTING = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the session names; one of our own only where none is set and all is local."""
    context = spark.sparkContext
    folder = spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ConfigError(f"set {SETTING} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared folder and read back: short lineage, computed once,
    and still there when an executor is lost."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder that `new_folder` named, once nothing reads it again."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def folder_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder, none where there is no such folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
