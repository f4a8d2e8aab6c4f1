"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_kept: set[str] = set()
_setting = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session has it, or where it is unset and Spark runs in one process a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="flowframe-")
    return _own[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own for a table of this application, which is removed when the driver's process ends in order."""
    own = f"{shared_dir(spark)}/flowframe/{spark.sparkContext.applicationId}"
    if own not in _kept:
        _kept.add(own)
        atexit.register(_forget, spark, own)
    return f"{own}/{uuid.uuid4().hex}/{name}"


def _forget(spark: SparkSession, path: str) -> None:
    """Removes an application's tables; at the process's end the JVM may be gone, and then they stay."""
    with contextlib.suppress(Exception):
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder in any file system that Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any file system that Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file with a text in any file system that Spark knows, unless it exists. True if it was made."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(place):
        return False
    try:
        out = system.create(place, False)
    except Exception:
        if system.exists(place):  # another run was first
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


#: Spark's setting for the rows of an Arrow batch; long rows need fewer to keep workers small.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def staged(df: DataFrame, name: str, arrow_rows: int | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again: lineage ends there, lost executors cost nothing.

    ``arrow_rows`` bounds the rows that Python functions of ``df`` get at once.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    if arrow_rows is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    with _setting:
        before = spark.conf.get(ARROW_ROWS)
        try:
            spark.conf.set(ARROW_ROWS, str(arrow_rows))
            df.write.parquet(path)
        finally:
            spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)
