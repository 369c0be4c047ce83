"""Cutting lineage between stages that several branches read."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_TABLES: list[tuple[SparkSession, str]] = []


def _folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of our own on a local master, which a
    cluster's executors would not see."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="folioflow-stages-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder, True)
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and written as a Parquet table to the shared folder, so a branch neither plans nor computes
    it again and reads only the columns it needs. The table lives as long as this process or until clear()."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/folioflow-stage-{uuid.uuid4().hex}"
    if not _TABLES:
        atexit.register(clear)
    df.write.mode("error").parquet(path)
    _TABLES.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A path of our own in the shared folder, deleted as the tables of settled() are."""
    path = f"{_folder(spark)}/folioflow-{name}-{uuid.uuid4().hex}"
    if not _TABLES:
        atexit.register(clear)
    _TABLES.append((spark, path))
    return path


def clear() -> None:
    """Delete the tables of all stages; DataFrames over them are not to be used any more."""
    for spark, path in _TABLES:
        with contextlib.suppress(Exception):  # the session may be gone: the folder is the cluster's to clean
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
    _TABLES.clear()
