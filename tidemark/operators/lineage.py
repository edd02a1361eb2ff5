"""Cuts the plan of an iteration, and says where tables go that jobs leave for each other: the shared folder, which outlives executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, as the session or the context names it. Where it is unset, on a local master only, a
    folder of this process that goes when it ends."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(shared_folder, "own"):
        shared_folder.own = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, shared_folder.own, ignore_errors=True)
    return f"file://{shared_folder.own}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in the shared folder. Spark deletes it with the last reference to it where
    spark.cleaner.referenceTracking.cleanCheckpoints is set; a folder of this process goes when it ends."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
