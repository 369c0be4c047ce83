"""Session plumbing shared by the operators: code shipping and lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch at most.
ROWS, _BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
_TABLES: list[tuple[SparkSession, str]] = []


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers that have no copy of it.

    The archive goes through Spark's own file server, so it needs no folder that
    driver and executors share. Texts go to the workers at most `ROWS` at a time, so that batches of long
    texts stay small.
    """
    if int(spark.conf.get(_BATCH, "10000")) > ROWS:
        spark.conf.set(_BATCH, str(ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_folioflow_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    folder = tempfile.mkdtemp(prefix="folioflow-")
    archive = os.path.join(folder, "folioflow_pkg.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for base, dirs, names in os.walk(package):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(archive)
    sc._folioflow_shipped = True
    atexit.register(shutil.rmtree, folder, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of our own on a local master; a cluster's
    executors would not see it, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="folioflow-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder, True)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files every executor sees."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/folioflow-{name}-{uuid.uuid4().hex}"
    if not _TABLES:
        atexit.register(_drop_tables)
    df.write.mode("error").parquet(path)
    _TABLES.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing will read again."""
    for entry in list(_TABLES):
        if any(os.path.basename(entry[1]) in f for f in df.inputFiles()[:1]):
            _delete(*entry)
            _TABLES.remove(entry)


def tables() -> int:
    """How many tables of written() there are now; a mark for discard_since()."""
    return len(_TABLES)


def discard_since(mark: int, kept: DataFrame) -> None:
    """Delete the tables written since the mark, but for the one that kept reads."""
    own = {os.path.basename(os.path.dirname(f)) for f in kept.inputFiles()[:1]}
    for entry in _TABLES[mark:]:
        if os.path.basename(entry[1]) not in own:
            _delete(*entry)
            _TABLES.remove(entry)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished rounds: it does so when the driver's JVM collects what stands for them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone: the folder is the cluster's to clean
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def _drop_tables() -> None:
    for spark, path in _TABLES:
        _delete(spark, path)
    _TABLES.clear()
