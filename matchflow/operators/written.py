"""Intermediate tables: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, under spark.checkpoint.dir.

    Without that setting a local session (tests) gets one in /tmp; on a cluster, whose executors would each
    write to a disk of their own, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            root = current.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            root = "/tmp/checkpoints"
        else:
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """A folder of its own under the run's one.

    Results may read their tables lazily, so these stay until drop_intermediates(spark) removes all of the run.
    """
    return f"{run_folder(spark)}/{uuid.uuid4().hex}"


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop_intermediates(spark: SparkSession) -> None:
    """Remove every intermediate table of this application; results that were not written are lost with them."""
    removed(spark, run_folder(spark))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back.

    Written files survive the loss of executors, and every later reader finds the same rows.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Remove the folder of a checkpointed table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        removed(df.sparkSession, folder)


def by_row_or_key(df: DataFrame, key: str, of_rows: Callable[[DataFrame], DataFrame], of_keys: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A result by key: of_rows for keys of one row, which need no shuffle of what the row holds, of_keys for the rows of the others.

    The keys alone are shuffled, to find those of several rows.
    """
    several = checkpointed(df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__key"))
    met = F.col(key).eqNullSafe(F.col("__key"))
    once = of_rows(df.join(several, met, "left_anti"))
    return once.unionByName(of_keys(df.join(several, met, "left_semi")))
