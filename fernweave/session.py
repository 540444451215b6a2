"""Session helpers: tables of a directory and lineage cuts in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the directory `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame, release: bool = False) -> DataFrame:
    """`df` written once to the checkpoint folder, so that later reads don't recompute it.

    With `release` the shuffle files that were made for it are deleted as soon as it is
    written; otherwise they stay until the driver happens to collect its garbage.

    The folder is the one the cluster names in `spark.checkpoint.dir`. Only a local
    session without that setting gets a folder of its own; elsewhere a missing setting
    is an error, as a machine-local folder would be lost with its executor.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is not set on this cluster")
            shared = tempfile.mkdtemp(prefix="fernweave-checkpoint-")
        context.setCheckpointDir(shared)
    if not release:
        return df.checkpoint(eager=True)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a frame takes the setting when it is made
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def delete_cut(df: DataFrame) -> None:
    """Delete the checkpoint of a frame from `cut_lineage`; it and what was made lazily from it can't be read any more."""
    context = df.sparkSession.sparkContext
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = context._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
