"""Comment and conversation records: JSON in and out, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMENT = "text STRING, label_ai INT, label_ragebait INT, username STRING, timestamp STRING, parent_topic STRING, source STRING"
FIELDS = ("text", "label_ai", "label_ragebait", "username", "timestamp", "parent_topic", "source")
MESSAGES = "array<struct<speaker:string,text:string,timestamp:string>>"


def lenient_timestamp(text: Column) -> Column:
    """ISO-8601 with Z or an offset; null if it is none."""
    return F.try_to_timestamp(text)


def _comments(raw: DataFrame, value: Column, origin: Column) -> DataFrame:
    """Known keys by schema, every other key into meta; the source defaults to the origin."""
    parsed = raw.select(F.from_json(value, f"struct<{COMMENT.replace(' STRING', ':string').replace(' INT', ':int').replace(', ', ',')}>").alias("c"), F.from_json(value, "map<string,string>").alias("m"), origin.alias("_origin"))
    rest = F.map_filter("m", lambda k, v: ~k.isin(*FIELDS))
    return parsed.where("c.text is not null").select("c.text", "c.label_ai", "c.label_ragebait", "c.username", lenient_timestamp(F.col("c.timestamp")).alias("timestamp"), "c.parent_topic", F.coalesce("c.source", "_origin").alias("source"), rest.alias("meta"))


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines and a byte-order mark are tolerated."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where("trim(value) <> ''")
    return _comments(lines, F.col("value"), F.lit(None).cast("string"))


def read_comment_files(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object, or a list of them, for each file."""
    raw = spark.read.text(path, wholetext=True).select(F.trim(F.regexp_replace("value", "^﻿", "")).alias("value"), F.col("_metadata.file_path").alias("file"))
    one = F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    return _comments(raw.select(F.explode(one).alias("value"), "file"), F.col("value"), F.col("file"))


def read_conversations(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """messages, label, source from JSON lines or files; a bare list is a conversation without label."""
    raw = spark.read.text(path, wholetext=whole_files).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file")).where("value <> ''")
    inner = F.from_json("value", f"struct<messages:{MESSAGES},label:int,source:string>")
    bare = F.col("value").startswith("[")
    out = raw.select(inner.alias("c"), F.from_json("value", MESSAGES).alias("b"), bare.alias("bare"), "file")
    m = F.when(F.col("bare"), F.col("b")).otherwise(F.col("c.messages"))
    typed = F.transform(m, lambda x: F.struct(x["speaker"].alias("speaker"), x["text"].alias("text"), lenient_timestamp(x["timestamp"]).alias("timestamp")))
    return out.select(typed.alias("messages"), F.when(~F.col("bare"), F.col("c.label")).alias("label"), F.coalesce(F.when(~F.col("bare"), F.col("c.source")), "file").alias("source"))


def turns(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row for each message, in order."""
    return conversations.select(key, F.posexplode("messages").alias("turn", "m")).select(key, "turn", "m.speaker", "m.text", "m.timestamp")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A term list: one a line, # comments, lower case."""
    t = F.lower(F.trim(F.regexp_replace("value", "^﻿", "")))
    return spark.read.text(path).select(t.alias("term")).where("term <> '' and not startswith(term, '#')")


def read_valued_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """word, valence, arousal, dominance: CSV with # lines; bad rows go, dominance defaults to 0.5, the last of equal words holds."""
    raw = spark.read.csv(path, header=True, comment="#", schema="word string, valence string, arousal string, dominance string")
    n = lambda c: F.expr(f"try_cast(trim({c}) as double)")
    out = raw.select(F.lower(F.trim("word")).alias("word"), n("valence").alias("valence"), n("arousal").alias("arousal"), F.coalesce(n("dominance"), F.lit(0.5)).alias("dominance"), F.monotonically_increasing_id().alias("ord"))
    out = out.where("word <> '' and valence is not null and arousal is not null")
    return out.groupBy("word").agg(F.max_by(F.struct("valence", "arousal", "dominance"), "ord").alias("v")).select("word", "v.*")


def read_full_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated word, valence, arousal, dominance in [0, 1]; valence becomes 2v - 1."""
    raw = spark.read.csv(path, sep="\t", schema="word string, v string, a string, d string")
    n = lambda c: F.expr(f"try_cast({c} as double)")
    return raw.select(F.lower(F.trim("word")).alias("word"), (2 * n("v") - 1).alias("valence"), n("a").alias("arousal"), n("d").alias("dominance")).where("valence is not null")


def read_category_dictionary(spark: SparkSession, path: str, wanted: str = "vice") -> DataFrame:
    """Stems of the categories whose name contains `wanted`: a %-delimited list of categories, then stems with category ids."""
    parts = spark.read.text(path, wholetext=True).select(F.split("value", "%").alias("p"))
    lines = lambda i: F.filter(F.split(F.get("p", F.lit(i)), r"\r?\n"), lambda x: F.trim(x) != "")
    cats = F.filter(F.transform(lines(1), lambda x: F.split(F.trim(x), r"\s+", 2)), lambda x: F.contains(F.lower(F.get(x, F.lit(1))), F.lit(wanted)))
    held = parts.select(F.transform(cats, lambda x: F.get(x, F.lit(0))).alias("ids"), F.explode(lines(2)).alias("line")).select("ids", F.split(F.trim("line"), r"\s+").alias("w"))
    return held.where(F.arrays_overlap("ids", F.slice("w", F.lit(2), F.size("w")))).select(F.regexp_replace(F.lower(F.get("w", F.lit(0))), r"\*$", "").alias("stem")).distinct()


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """ord, name, mu, sigma of a JSON object of [mu, sigma] pairs or {mu, sigma} objects, in file order."""
    raw = spark.read.text(path, wholetext=True)
    pairs = raw.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("ord", "e"))
    v = F.col("e.value")
    return pairs.select("ord", F.col("e.key").alias("name"), F.coalesce(F.get(F.from_json(v, "array<double>"), F.lit(0)), F.get_json_object(v, "$.mu").cast("double")).alias("mu"), F.coalesce(F.get(F.from_json(v, "array<double>"), F.lit(1)), F.get_json_object(v, "$.sigma").cast("double")).alias("sigma"))


def write_baseline(baseline: DataFrame, name: str, path: str, mode: str = "overwrite") -> None:
    """One JSON object of {mu, sigma} by name, in the order of `ord` if there is one; a baseline is a few rows."""
    order = "ord" if "ord" in baseline.columns else name
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).cast("string").alias("n"), F.struct("mu", "sigma").alias("v"))))
    whole = baseline.agg(F.to_json(F.map_from_entries(F.transform(rows, lambda r: F.struct(r["n"], r["v"])))).alias("value"))
    whole.write.mode(mode).text(path)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """text and source of JSON lines; blank texts go."""
    return spark.read.schema("text string, source string").json(path).where("trim(coalesce(text, '')) <> ''")


def write_templates(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select("text", *(["source"] if "source" in df.columns else [])).write.mode(mode).json(path)


def write_comments(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; meta's keys stand beside the fields, nulls are dropped."""
    fields = F.struct(*[F.col(c) for c in FIELDS if c in df.columns])
    known = F.from_json(F.to_json(fields), "map<string,string>")
    line = F.to_json(F.map_concat(F.coalesce("meta", F.create_map().cast("map<string,string>")), known)) if "meta" in df.columns else F.to_json(fields)
    df.select(line.alias("value")).write.mode(mode).text(path)


def write_conversations(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document for each row: the score response."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
