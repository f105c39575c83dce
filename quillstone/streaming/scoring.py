"""The scoring service as a stream: files in, features and verdicts out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema: str, form: str = "json", files_each: int = 100) -> DataFrame:
    """New complete files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).format(form).load(path)


def serve(requests: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True, form: str = "parquet") -> StreamingQuery:
    """Score each micro-batch and write it as Parquet, or as JSON responses with nulls kept; a batch that is run again replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").format(form).options(**({"ignoreNullFields": "false"} if form == "json" else {})).save(f"{out}/batch={number}")

    writer = requests.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
