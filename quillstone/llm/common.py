"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: a space and the control characters 09 to 0D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder; a new one of our own only where none is set and all runs in one process."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back.

    What is read back no longer depends on any executor staying alive.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, label: str, what: Column) -> tuple[DataFrame, int]:
    """materialize, and the count of rows for which `what` holds, taken in the same job.

    A repeated task may count twice, so use it to tell none from some.
    """
    seen = Observation()
    out = materialize(df.observe(seen, F.count_if(what).alias("n")), label)
    return out, int(seen.get["n"])


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of few rows made of a literal, so no Python runs on the executors."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def word_list(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, SPACE), "")


def span_list(spans: Column) -> Column:
    """kind:start:end of an array of (start, ord, kind, end), by start, then kind as listed."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
