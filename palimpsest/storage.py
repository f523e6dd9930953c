"""Where intermediate tables go: the checkpoint folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def use_checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where none is set a local one serves a local master; on a cluster that is an error."""
    sc = spark.sparkContext
    context = sc._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="palimpsest-checkpoint-"))
    return context.getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df in the shared checkpoint folder; reading them again survives lost executors."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by keys over several tasks for each core: before steps that make much work of small rows, which often lie in one file."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{use_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discarded(spark: SparkSession, folder: str) -> None:
    """Delete a written table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
