"""Session helpers shared by every part of the library."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once per Spark application, as a Python file."""
    sc = spark.sparkContext
    if getattr(sc, "_frameloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="frameloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "frameloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(archive)
    sc._frameloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not getattr(sc, "_frameloom_shared", None):
        sc._frameloom_shared = tempfile.mkdtemp(prefix="frameloom-shared-")
        atexit.register(shutil.rmtree, sc._frameloom_shared, ignore_errors=True)
    return "file://" + sc._frameloom_shared


@contextmanager
def dropping_shuffles(spark: SparkSession):
    """Inside, the shuffle files of a finished query go at once instead of at the driver's next garbage collection."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, *, codec: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut, safe when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/frameloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with dropping_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Delete what ``written`` has left in the shared folder for this application; frames that read it end with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/frameloom-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
