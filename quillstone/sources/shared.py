"""Tables in the folder that all executors share: how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """Tables cannot be written where all executors see them.  No ValueError, so that no code that takes those for a bad row or plan passes over it."""


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a new one of our own only where none is set and all runs in one process."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    What is read back no longer depends on any executor staying alive, and its plan is
    a scan, so iterations do not pile up plans or constraints.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder partition by partition: what reads it has the same partitions in the same order."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
