"""Keeping parsed text as a columnar table for the length of a run.

A run reads its source several times. Text formats are parsed whole each time, so where the session
names a shared folder the parsed rows are written there once and read by column after that. The
table is an ordinary file set: a lost executor costs nothing but the task it ran.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """The folder all executors can reach, if the session names one."""
    return spark.conf.get("spark.checkpoint.dir", None)


def stage(df: DataFrame) -> tuple[DataFrame, str | None]:
    """``df`` as a columnar table, and its path; unchanged, and no path, without a shared folder."""
    folder = shared_folder(df.sparkSession)
    if not folder:
        return df, None
    path = f"{folder.rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, path: str) -> None:
    """Removes a staged table."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
