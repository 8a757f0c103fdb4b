"""Tables written between the phases of a job.

A phase that several later ones read is written as Parquet under the shared
folder of ``spark.checkpoint.dir``: its rows are computed once, survive lost
executors, and have known sizes, so Spark can choose join strategies by them.
"""

from __future__ import annotations

import contextlib
import gc

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session while a job runs."""
    old = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.  Its shuffle files
    go as soon as it is written: nothing reads them again.  A page of Parquet
    ends by its size from the first row on (by default not before 100 rows):
    with rows of megabytes, readers and writers hold whole pages of them."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("parquet.page.size.row.check.min", "1").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by ``saved`` that nothing reads any more."""
    path = getattr(df, "_saved_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, limit: int):
    """While a job runs, rows go to Python in batches of about ``limit`` bytes:
    for rows of megabytes, of which the default holds many at once."""
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(limit)):
        yield


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished phases now.

    Its cleaner acts when the driver's collector finds the plans
    unreachable, which in a quiet driver may be long after the phase."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
