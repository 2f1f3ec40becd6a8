"""The folder that driver and executors share, and cutting lineage with tables written there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only where that is unset and all runs on one machine, as in tests, a temporary folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gradloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    """A path below the shared folder that no other call returns; deleted when the driver ends."""
    path = f"{shared_dir(spark)}/gradloom-{kind}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: the folder's owner cleans it
        pass


ROWS_A_FILE = 500_000


def cut(df: DataFrame, kind: str = "cut", rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again.

    A plan that reads ``df`` several times computes it once, and an executor lost later
    costs a read of these files and not the whole lineage. ``rows`` is how many narrow rows
    there are at most, where the caller knows: a file is then written for each half million,
    and not one for each shuffle partition.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = new_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
