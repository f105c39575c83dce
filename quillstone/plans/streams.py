"""Streams over files written from the given tables, held against the SQL of their batch forms."""

from __future__ import annotations

from math import log

from pyspark.sql import functions as F

from quillstone.operators import decisions as D, features, metrics as M, models
from quillstone.plans import texts, wide
from quillstone.plans.files import fresh
from quillstone.plans.registry import ORACLE, query, table
from quillstone.streaming import scoring, stateful


def timed_files(spark, sf_dir, name: str, parts: int = 6) -> str:
    """The events as files, each a stretch of time, written in that order."""
    path = fresh(spark, name)
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_id").alias("id"))
    # taken once: an approximate percentile hangs on the order in which its parts are merged, and the files must not overlap
    edges = e.agg(F.percentile_approx(F.unix_micros("ts"), [k / parts for k in range(1, parts)], 1000)).first()[0] or []
    placed = e.withColumn("part", sum((F.when(F.unix_micros("ts") > x, 1).otherwise(0) for x in edges), F.lit(0)))
    for k in range(parts):
        placed.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, stream, name: str, mode: str):
    """Rows that a stream gives, by batch."""
    out, state = fresh(spark, f"{name}-out"), fresh(spark, f"{name}-state")
    put = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/number={number}")
    with stateful.rocksdb(spark):
        stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", out).parquet(f"{out}/number=*").drop("number")


EVENT = "user_id long, ts timestamp, value double, id long"


@query(ORACLE["q_rate_limiter"])
def q_limiter_stream(spark, sf_dir):
    """The limiter over a stream of files in time order, with state that expires."""
    hits = scoring.file_stream(spark, timed_files(spark, sf_dir, "hits"), EVENT, form="parquet", files_each=1)
    out = stateful.limited_with_expiry(hits.select("user_id", "ts", "id"), "user_id", "ts", 7 * 86400.0, 5)
    return run(spark, out, "limiter", "append").drop("batch")


@query(ORACLE["q_account_posterior"])
def q_posterior_stream(spark, sf_dir):
    """The last posterior of each account of a stream of scores."""
    events = scoring.file_stream(spark, timed_files(spark, sf_dir, "scores"), EVENT, form="parquet", files_each=1)
    scores = events.withColumn("score", F.least(F.lit(1.0), F.col("value") / 100))
    out = run(spark, stateful.running_posterior(scores, "user_id", "ts", "score", 0.05, log(0.8 * 0.9 / (0.1 * 0.2)), idle=400 * 86400.0), "posterior", "update")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("n", "mean_score", "posterior"), "batch").alias("r"))
    return last.select("user_id", "r.n", *[F.round(f"r.{c}", 6).alias(c) for c in ("mean_score", "posterior")])


#: A saved head over two features: what a service loads.
HEAD = models.Head(["psi_6", "psi_8"], [0.1, 0.0], [0.2, 1.5], [0.4, 2.5], [([1.25, -0.5], 0.1), ([0.75, 0.25], -0.2)], [(1.1, 0.05), (0.9, -0.1)])
_INPUTS = f"psi_6 AS (SELECT doc_id, text, ln(1 + {texts._HITS(texts.AI_PATTERNS)} / ({texts._NT} / 20.0)) AS a, {texts._HITS(texts.HEDGES)} / ({texts._NT} / 100.0) AS b FROM en)"
_SCALED = r"z AS (SELECT doc_id, text, (CASE WHEN regexp_matches(text, '\S') THEN a ELSE 0.1 END - 0.2) / 0.4 AS a, (CASE WHEN regexp_matches(text, '\S') THEN b ELSE 0.0 END - 1.5) / 2.5 AS b FROM psi_6)"
_SCORE = "(1 / (1 + exp(-(1.1 * (1.25 * a - 0.5 * b + 0.1) + 0.05))) + 1 / (1 + exp(-(0.9 * (0.75 * a + 0.25 * b - 0.2) - 0.1)))) / 2"
_SCORED = f"{texts.EN}, {_INPUTS}, {_SCALED}, s AS (SELECT doc_id, text, {_SCORE} AS p FROM z)"


def saved_head(spark) -> models.Head:
    """The head from its bundle."""
    path = fresh(spark, "head")
    models.save_head(spark, HEAD, path)
    return models.load_head(spark, path)


def scores(spark, sf_dir, docs, head: models.Head):
    skip = {name for name, *_ in features.COMMENT_FEATURES} - {"phrases", "hedges"}
    return head.score(features.comment_features(docs, wide.lexicons(spark, sf_dir), skip=skip), "p")


@query(f"WITH {_SCORED} SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 400 WHEN length(text) > 4000 THEN 413 ELSE 200 END AS status, CASE WHEN trim(coalesce(text, '')) <> '' AND length(text) <= 4000 THEN round(p, 6) END AS p FROM s")
def q_scored_service(spark, sf_dir):
    """Requests of a file stream answered with the score of a saved head, or a status that says why not."""
    requests, out, state = fresh(spark, "score-requests"), fresh(spark, "score-answers"), fresh(spark, "score-state")
    table(spark, sf_dir, "documents").select("doc_id", "text").write.parquet(requests)
    head = saved_head(spark)

    def answer(batch):
        told = batch.withColumn("status", D.request_status(F.col("text"), F.lit(True)))
        scored = scores(spark, sf_dir, told.where("status = 200").select("doc_id", "text"), head).select("doc_id", F.round("p", 6).alias("p"))
        return told.select("doc_id", "status").join(scored, "doc_id", "left")

    stream = scoring.file_stream(spark, requests, "doc_id long, text string", form="parquet", files_each=2)
    scoring.serve(stream, answer, out, state).awaitTermination()
    return spark.read.parquet(f"{out}/*")


@query(f"""WITH {_SCORED}, t AS (SELECT round(p, 9) AS p, quality AS y FROM s JOIN labels USING (doc_id)), c AS (SELECT p, count(*) FILTER (WHERE y = 1) AS a, count(*) FILTER (WHERE y = 0) AS b FROM t GROUP BY p),
r AS (SELECT *, sum(b) OVER (ORDER BY p) AS up_to FROM c) SELECT round(sum(a * (up_to - b / 2)) / (sum(a) * sum(b)), 6) AS auc FROM r""")
def q_head_auc(spark, sf_dir):
    """The AUC of the saved head on the rows with labels."""
    scored = scores(spark, sf_dir, texts.documents(spark, sf_dir), saved_head(spark)).select("doc_id", F.round("p", 9).alias("p"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("y"))
    return M.roc_auc(scored.join(labels, "doc_id"), "p", "y").select(F.round("auc", 6).alias("auc"))
