"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, through Spark's own reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Where it is unset, a session on one machine
    gets a fresh one; any other master is an error, as its executors would each write to a disk of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        where = spark.sparkContext.getCheckpointDir()
    return where


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Spark then deletes the shuffle files of a query when that query is done.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back, which cuts its lineage.

    What was shuffled for it is deleted when the table is complete, so that steps do not add up on the disks."""
    spark = df.sparkSession
    path, before = new_path(spark, what), spark.conf.get(FREE, "false")
    spark.conf.set(FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`written` made and that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Gives memory that a Python worker no longer uses back to the system: workers live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the like, that no column has."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def text_of(column: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))
