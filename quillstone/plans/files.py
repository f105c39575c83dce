"""Sources and sinks: tables written to files of the shared folder by a sink and read back by the source, held against SQL on the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillstone.functions import numeric as N, text as T
from quillstone.operators import decisions as D, geometry as G, parsers as P, relational as R, signal as S
from quillstone.plans import scores, spaces, texts
from quillstone.plans.lexicons import ANCHORS
from quillstone.plans.registry import ORACLE, listed, query, sql_list, sql_values, table
from quillstone.sources import clouds, ply, records
from quillstone.sources.shared import shared_dir
from quillstone.streaming import scoring


def fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def lines(df, value, path: str) -> None:
    df.select(value.alias("value")).write.text(path)


def one_text(df, order: str, value, head: str = "", between: str = "\n"):
    """A small table as one text, in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return df.agg(F.concat(F.lit(head), F.array_join(F.transform(rows, lambda x: x["v"]), between)).alias("value"))


@query("""SELECT doc_id, source AS username, md5(text) AS digest, CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-05-01 10:00:00' + INTERVAL 1 SECOND * (doc_id % 86400) END AS at, 'feed' AS source, lang AS lang FROM documents WHERE text IS NOT NULL""")
def q_comment_lines(spark, sf_dir):
    d, path = table(spark, sf_dir, "documents"), fresh(spark, "comments")
    at = F.from_unixtime(F.unix_timestamp(F.lit("2024-05-01 10:00:00").cast("timestamp")) + F.col("doc_id") % 86400, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    stamp = F.when(F.col("doc_id") % 3 == 0, at).when(F.col("doc_id") % 3 == 1, "no time at all")
    meta = F.create_map(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("lang"), F.col("lang"))
    records.write_comments(d.select("text", F.lit(None).cast("int").alias("label_ai"), F.col("source").alias("username"), stamp.alias("timestamp"), F.lit("feed").alias("source"), meta.alias("meta")), path)
    back = records.read_comments(spark, path)
    return back.select(F.col("meta")["doc"].cast("long").alias("doc_id"), "username", F.md5("text").alias("digest"), F.col("timestamp").cast("timestamp_ntz").alias("at"), "source", F.col("meta")["lang"].alias("lang"))


@query("SELECT n_name AS text, n_regionkey AS label_ai, n_nationkey % 2 = 1 AS from_path, n_nationkey::VARCHAR AS meta_key FROM nation")
def q_comment_files(spark, sf_dir):
    """One object, or a list of one, in each file; the source defaults to the file's path."""
    n, path = table(spark, sf_dir, "nation"), fresh(spark, "comment-files")
    k = F.col("n_nationkey")
    one = F.to_json(F.struct(F.col("n_name").alias("text"), F.col("n_regionkey").alias("label_ai"), F.when(k % 2 == 0, "given").alias("source"), k.cast("string").alias("key")))
    n.select(F.when(k % 3 == 0, F.concat(F.lit("["), one, F.lit("]"))).otherwise(one).alias("value"), k.alias("file")).write.partitionBy("file").text(path)
    back = records.read_comment_files(spark, f"{path}/*")
    return back.select("text", "label_ai", F.contains("source", F.lit("file=")).alias("from_path"), F.col("meta")["key"].alias("meta_key"))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS turn, role AS speaker, md5(text) AS digest, CASE WHEN conv_id % 2 = 0 THEN (conv_id % 2)::INT END AS label FROM conversations")
def q_conversation_lines(spark, sf_dir):
    """Objects with a label and bare lists without one."""
    c, path = table(spark, sf_dir, "conversations"), fresh(spark, "conversations")
    message = F.struct("turn", F.col("role").alias("speaker"), "text", F.lit(None).cast("string").alias("timestamp"))
    whole = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(message)), lambda m: F.struct(m["speaker"].alias("speaker"), m["text"].alias("text"), m["timestamp"].alias("timestamp"))).alias("messages"))
    even = whole.where("conv_id % 2 = 0").select("messages", F.lit(0).alias("label"), F.col("conv_id").cast("string").alias("source"))
    records.write_conversations(even, path, "append")
    lines(whole.where("conv_id % 2 = 1"), F.to_json("messages"), f"{path}/bare")
    objects, bare = records.read_conversations(spark, f"{path}/*.json"), records.read_conversations(spark, f"{path}/bare")
    turns = lambda x: x.select("key", "label", F.posexplode("messages").alias("turn", "m"))
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("t0"), F.count("*").alias("n")).select(F.col("conv_id").cast("string").alias("key"), "t0", "n")
    # a bare list has no place for an id: its texts tell which one it is
    found = bare.withColumns({"t0": F.get("messages", F.lit(0))["text"], "n": F.size("messages").cast("long")}).join(first.where("key % 2 = 1"), ["t0", "n"])
    out = turns(objects.withColumn("key", F.col("source"))).unionByName(turns(found))
    return out.select(F.col("key").cast("long").alias("conv_id"), "turn", F.col("m.speaker").alias("speaker"), F.md5("m.text").alias("digest"), "label")


@query(f"SELECT DISTINCT lower(trim(n_name)) AS term FROM nation UNION SELECT * FROM (VALUES {sql_values([(a,) for a in ANCHORS])}) t(term)")
def q_term_lines(spark, sf_dir):
    """A term file joined with the built-in terms."""
    n, path = table(spark, sf_dir, "nation"), fresh(spark, "terms")
    lines(n, F.when(F.col("n_nationkey") % 5 == 4, F.concat(F.lit("# a remark\n  \n"), F.col("n_name"))).otherwise(F.concat(F.lit("  "), F.upper("n_name"))), path)
    return records.read_lines(spark, path).union(texts.words(spark, ANCHORS)).distinct()


_PART = "p AS (SELECT *, 'w' || p_partkey % 700 AS word FROM part WHERE p_partkey % 7 > 0)"


@query(f"WITH {_PART} SELECT word, arg_max(round(p_size / 25 - 1, 2), p_partkey) AS valence, arg_max(round(p_size / 50, 2), p_partkey) AS arousal, arg_max(CASE WHEN p_partkey % 2 = 0 THEN 0.25 ELSE 0.5 END, p_partkey)::DOUBLE AS dominance FROM p GROUP BY word")
def q_valued_lexicon(spark, sf_dir):
    p, path = table(spark, sf_dir, "part"), fresh(spark, "valued")
    k = F.col("p_partkey")
    row = F.concat_ws(",", F.concat(F.lit(" W"), k % 700), F.when(k % 7 == 0, "bad").otherwise(F.round(F.col("p_size") / 25 - 1, 2).cast("string")), F.round(F.col("p_size") / 50, 2).cast("string"), F.when(k % 2 == 0, "0.25").otherwise(""))
    one_text(p, "p_partkey", row, "word,valence,arousal,dominance\n# a remark\n").write.text(path)
    return records.read_valued_lexicon(spark, path)


@query("SELECT 'w' || p_partkey AS word, round(2 * round(p_size / 50, 2) - 1, 6) AS valence, round(p_size % 10 / 10, 2) AS arousal, 0.5::DOUBLE AS dominance FROM part")
def q_full_lexicon(spark, sf_dir):
    p, path = table(spark, sf_dir, "part"), fresh(spark, "full")
    lines(p, F.concat_ws("\t", F.concat(F.lit("W"), F.col("p_partkey")), F.round(F.col("p_size") / 50, 2), F.round(F.col("p_size") % 10 / 10, 2), F.lit("0.5")), path)
    return records.read_full_lexicon(spark, path).withColumn("valence", F.round("valence", 6))


@query("SELECT DISTINCT lower(n_name) AS stem FROM nation WHERE n_regionkey % 2 = 1 OR (n_regionkey + 1) % 5 % 2 = 1")
def q_category_dictionary(spark, sf_dir):
    """Nations as stems of two categories each; odd regions are categories of the wanted sort."""
    n, r, path = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), fresh(spark, "categories")
    k = F.col("r_regionkey")
    cats = one_text(r, "r_regionkey", F.concat_ws("\t", k, F.when(k % 2 == 1, "HarmVice").otherwise("CareVirtue")), "%\n")
    stems = one_text(n, "n_nationkey", F.concat(F.upper("n_name"), F.lit("*\t"), F.col("n_regionkey"), F.lit(" "), (F.col("n_regionkey") + 1) % 5), "\n%\n")
    cats.join(F.broadcast(stems.withColumnRenamed("value", "rest"))).select(F.concat("value", "rest").alias("value")).write.text(path)
    return records.read_category_dictionary(spark, path)


@query(ORACLE["q_punct_baseline"])
def q_baseline_json(spark, sf_dir):
    from quillstone.operators import comments

    path = fresh(spark, "baseline")
    records.write_baseline(comments.punctuation_baseline(comments.punctuation_wide(texts.documents(spark, sf_dir))), "pattern", path)
    return records.read_baseline(spark, path).select(F.col("name").alias("pattern"), *texts.r6("mu", "sigma"))


@query("SELECT md5(text) AS digest, 'item' AS source FROM benchmark WHERE trim(coalesce(text, '')) <> ''")
def q_template_lines(spark, sf_dir):
    b, path = table(spark, sf_dir, "benchmark"), fresh(spark, "templates")
    records.write_templates(b.select("text", F.lit("item").alias("source")).unionByName(listed(spark, [("  ", "x"), (None, "x")], "text string, source string")), path)
    return records.read_templates(spark, path).select(F.md5("text").alias("digest"), "source")


@query("SELECT p_brand, count(*) * 2 AS n FROM part GROUP BY 1")
def q_append_log(spark, sf_dir):
    p, path = table(spark, sf_dir, "part").select("p_partkey", "p_brand"), fresh(spark, "log")
    records.append_log(p, path)
    records.append_log(p, path)
    return spark.read.schema("p_partkey long, p_brand string").json(path).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT event_id, round(value, 3) AS value FROM events")
def q_report_table(spark, sf_dir):
    """A table that replaces the one before it."""
    e, path = table(spark, sf_dir, "events").select("event_id", F.round("value", 3).alias("value")), fresh(spark, "report")
    records.write_table(e.limit(3), path)
    records.write_table(e, path)
    return spark.read.csv(path, header=True, schema="event_id long, value double")


@query("""SELECT event_id, CASE WHEN event_id % 101 >= 50 THEN CASE WHEN event_id % 37 >= 18 THEN 'ai_ragebait' ELSE 'ai_only' END WHEN event_id % 37 >= 18 THEN 'human_ragebait' ELSE 'benign' END AS verdict, event_id % 101 / 100 AS p_ai, NULL::DOUBLE AS psi_1 FROM events""")
def q_score_report(spark, sf_dir):
    """Responses as JSON, nulls kept."""
    i, path = F.col("event_id"), fresh(spark, "responses")
    p = table(spark, sf_dir, "events").select("event_id", (i % 101 / 100).alias("p_ai"), (i % 37 / 36).alias("p_rb"))
    records.write_report(p.select("event_id", D.verdict(F.col("p_ai"), F.col("p_rb")).alias("verdict"), "p_ai", F.lit(None).cast("double").alias("psi_1")), path)
    raw = spark.read.text(path).where(F.contains("value", F.lit('"psi_1":null')))
    return raw.select(F.from_json("value", "event_id long, verdict string, p_ai double, psi_1 double").alias("r")).select("r.*")


@query(ORACLE["q_validation"])
def q_service(spark, sf_dir):
    """Requests come as files of a stream and are answered batch by batch."""
    requests, out, state = fresh(spark, "requests"), fresh(spark, "answers"), fresh(spark, "state")
    table(spark, sf_dir, "documents").select("doc_id", "text").write.json(requests)
    stream = scoring.file_stream(spark, requests, "doc_id long, text string", files_each=4)  # a few files a batch
    answer = lambda df: df.select("doc_id", D.request_status(F.col("text"), F.col("doc_id") % 50 != 0).alias("status"))
    scoring.serve(stream, answer, out, state, form="json").awaitTermination()
    return spark.read.schema("doc_id long, status int").json(f"{out}/*")


@query(f"WITH {spaces._PTS} SELECT (id % 4)::VARCHAR AS path, count(*) AS n, round(sum(x), 3) AS x, round(sum(y), 3) AS y, round(sum(z), 3) AS z, sum(id % 256)::BIGINT AS r FROM pts GROUP BY 1")
def q_cloud_files(spark, sf_dir):
    """Clouds encoded as binary files with colours, large ones as several, and parsed again."""
    shade = (F.col("id") % 256).cast("short")
    points = clouds.dealt(spaces.cloud(spark, sf_dir), "id").select((F.col("id") % 4).alias("key"), "part", "x", "y", "z", shade.alias("r"), F.lit(0).cast("short").alias("g"), F.lit(255).cast("short").alias("b"))
    files = clouds.encode_ply(points, "key", "part")
    v = clouds.vertices(files.select(F.col("key").alias("path"), "content"))
    return v.groupBy("path").agg(F.count("*").alias("n"), *[F.round(F.sum(F.round(a, 3)), 3).alias(a) for a in "xyz"], F.sum("r").alias("r"))


@query(f"WITH {spaces._PTS} SELECT id % 256 AS r, count(*) AS n, round(sum(x), 3) AS x, round(sum(y), 3) AS y, round(sum(z), 3) AS z FROM pts GROUP BY 1")
def q_cloud_ranges(spark, sf_dir):
    """A cloud written and read by the data source; its files are read in ranges of 100 records by as many tasks, or by MOST_TASKS of longer ranges."""
    path = fresh(spark, "cloud")
    shade = (F.col("id") % 256).cast("short")
    ply.write(spaces.cloud(spark, sf_dir).select("x", "y", "z", shade.alias("r"), F.lit(0).cast("short").alias("g"), F.lit(255).cast("short").alias("b")), path)
    v = ply.read(spark, path, 100)
    return v.groupBy(F.col("r").cast("long").alias("r")).agg(F.count("*").alias("n"), *[F.round(F.sum(F.round(a, 3)), 3).alias(a) for a in "xyz"])


@query(f"WITH {spaces._PTS} SELECT id % 3 = 0 AS third, count(*) AS n, round(sum(x), 3) AS x, round(sum(z), 3) AS z FROM pts GROUP BY 1")
def q_cloud_text_files(spark, sf_dir):
    """Clouds as ASCII files on disk, without colours."""
    path = fresh(spark, "ply")
    files = clouds.encode_ply(spaces.cloud(spark, sf_dir).select((F.col("id") % 3 == 0).cast("int").alias("third"), "x", "y", "z"), "third", binary=False)
    files.select("third", F.col("content").cast("string").alias("value")).write.partitionBy("third").text(path)
    v = clouds.read_ply(spark, f"{path}/*")
    return v.groupBy(F.contains("path", F.lit("third=1")).alias("third")).agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("x"), F.round(F.sum("z"), 3).alias("z"))


@query(f"WITH {spaces._PTS} SELECT printf('%.4f %.4f %.4f', x, y, z) || ' ' || id % 256 || ' 0 255' AS line FROM pts")
def q_xyz_lines(spark, sf_dir):
    path = fresh(spark, "xyz")
    clouds.write_xyz(spaces.cloud(spark, sf_dir).select("x", "y", "z", (F.col("id") % 256).alias("r"), F.lit(0).cast("long").alias("g"), F.lit(255).cast("long").alias("b")), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("""SELECT n_nationkey AS index, [n_nationkey + 0.5, -1.25, n_regionkey]::DOUBLE[] AS position, CASE WHEN n_nationkey % 5 > 0 THEN [0.0, 1.0, -2.5]::DOUBLE[] END AS up,
CASE WHEN n_nationkey % 5 > 0 THEN 0 ELSE 1 END AS n_missing, n_nationkey % 7 = 0 AS repeated FROM nation""")
def q_poses(spark, sf_dir):
    n, path = table(spark, sf_dir, "nation"), fresh(spark, "poses")
    k = F.col("n_nationkey")
    place = F.concat(F.lit("CamPosition: X = "), k + 0.5, F.lit(" Y = -1.25 Z = "), F.col("n_regionkey"))
    block = F.concat_ws("\n", F.concat(k, F.lit(")")), place, F.lit("CamForward X=1 Y=0 Z=0"), F.when(k % 7 == 0, "CamForward X=1 Y=0 Z=0"), F.lit("CamRight X=0 Y=0.5 Z=0"), F.when(k % 5 > 0, "camup: X = 0.0  Y = 1.0  Z = -2.5"))
    one_text(n, "n_nationkey", block).write.text(path)
    return clouds.read_poses(spark, path).select("index", "position", "up", F.size("missing").alias("n_missing"), "repeated")


@query("SELECT [[800.0 + n_nationkey, 0.0, 320.5], [0.0, 800.0, 240.25 - n_regionkey], [0.0, 0.0, 1.0]]::DOUBLE[][] AS k FROM nation")
def q_matrix(spark, sf_dir):
    """A camera matrix for each nation, each in a file of its own."""
    path = fresh(spark, "matrix")
    told = F.format_string("K = [%de0, 0, 320.5;\n 0 800.0 %s;\n 0 0 1]", 800 + F.col("n_nationkey"), (240.25 - F.col("n_regionkey")).cast("string"))
    table(spark, sf_dir, "nation").select("n_nationkey", told.alias("value")).write.partitionBy("n_nationkey").text(path)
    return clouds.read_matrix(spark, path)


@query(f"WITH b AS ({ORACLE['q_blur_mod']}), q AS (SELECT n_nationkey AS q, (n_nationkey * 5 % 28)::INT AS i, (n_nationkey * 7 % 24)::INT AS j FROM nation) SELECT q::INT AS q, v FROM q JOIN b USING (i, j)")
def q_judge_blur(spark, sf_dir):
    """A judge file of a grid and point queries, read and answered."""
    path, n = fresh(spark, "judge"), table(spark, sf_dir, "nation")
    cells = spark.range(31 * 24).select(F.floor(F.col("id") / 24).cast("int").alias("i"), (F.col("id") % 24).cast("int").alias("j"))
    grid = one_text(cells.join(spaces.grid(spark, sf_dir), ["i", "j"], "left").select((F.col("i") * 24 + F.col("j")).alias("o"), F.coalesce("v", F.lit(0)).cast("string").alias("v")), "o", F.col("v"), "31 24\n", " ")
    asked = one_text(n, "n_nationkey", F.concat_ws(" ", F.col("n_nationkey") * 5 % 28, F.col("n_nationkey") * 7 % 24), "\n25\n")
    grid.join(F.broadcast(asked.withColumnRenamed("value", "rest"))).select(F.concat("value", "rest").alias("value")).write.text(path)
    numbers = clouds.read_numbers(spark, path)
    blurred = G.blurred(clouds.grid_of(numbers).select("i", "j", "v"), 2, 3)
    q = clouds.queries_of(numbers).select("q", F.get("args", F.lit(0)).cast("int").alias("i"), F.get("args", F.lit(1)).cast("int").alias("j"))
    return q.join(blurred, ["i", "j"]).select("q", "v")


@query(r"SELECT doc_id FROM documents WHERE len(list_filter(string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+'), lambda w: w <> '')) BETWEEN 8 AND 80")
def q_token_band(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(T.within_words(F.col("text"))).select("doc_id")


@query("SELECT doc_id, toxic, NULL::INT AS quality FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, toxic, quality::INT FROM labels WHERE doc_id % 2 = 1")
def q_auxiliary_labels(spark, sf_dir):
    held = table(spark, sf_dir, "labels").select("doc_id", "toxic", F.col("quality").cast("int").alias("quality"))
    return R.union_all([R.without_label(held.where("doc_id % 2 = 0"), "quality"), held.where("doc_id % 2 = 1")])


@query("SELECT event_id FROM events WHERE value > 1.7")
def q_confidence_fixed(spark, sf_dir):
    return G.confident_above(table(spark, sf_dir, "events"), "value", 1.7).select("event_id")


@query("""WITH l AS (SELECT doc_id, CASE quality WHEN 0 THEN 'scam call' WHEN 1 THEN CASE toxic WHEN 1 THEN '1' ELSE 'ham' END END AS label, CASE doc_id % 4 WHEN 0 THEN 'train-scam' WHEN 1 THEN 'nonscam' WHEN 2 THEN 'benign' ELSE 'test' END AS split, doc_id % 3 = 0 AS s FROM labels)
SELECT doc_id, (CASE label WHEN 'scam call' THEN 1 WHEN '1' THEN 1 WHEN 'ham' THEN 0 ELSE CASE split WHEN 'train-scam' THEN 1 WHEN 'nonscam' THEN 0 WHEN 'benign' THEN 0 ELSE s::INT END END)::INT AS label FROM l""")
def q_inferred_label(spark, sf_dir):
    i = F.col("doc_id")
    told = F.when(F.col("quality") == 0, "scam call").when((F.col("quality") == 1) & (F.col("toxic") == 1), "1").when(F.col("quality") == 1, "ham")
    split = F.when(i % 4 == 0, "train-scam").when(i % 4 == 1, "nonscam").when(i % 4 == 2, "benign").otherwise("test")
    return table(spark, sf_dir, "labels").select("doc_id", P.inferred_label(told, split, F.when(i % 3 == 0, "Scam-set").otherwise("calls")).alias("label"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n >= 4")
def q_long_conversations(spark, sf_dir):
    return P.of_length(table(spark, sf_dir, "conversations"), "conv_id").select("conv_id", "turn")


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def q_fenced_json(spark, sf_dir):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```  "))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(T.without_fence(fenced), "$.k").cast("int").alias("k"))


@query("SELECT event_id, round(CASE WHEN value < 20 THEN sqrt((value - 20) ** 2 + (event_id % 7) ** 2) WHEN value > 60 THEN sqrt((value - 60) ** 2 + (event_id % 7) ** 2) ELSE event_id % 7 END, 6) AS d FROM events")
def q_segment_distance(spark, sf_dir):
    f = lambda v: F.lit(float(v))
    d = N.segment_distance(F.col("value"), (F.col("event_id") % 7).cast("double"), f(20), f(0), f(60), f(0))
    return table(spark, sf_dir, "events").select("event_id", F.round(d, 6).alias("d"))


@query("SELECT p_partkey, list_reduce([1]::HUGEINT[] || list_transform(range(p_size), lambda i: p_partkey), lambda a, b: a * b % 1000000007)::BIGINT AS v FROM part")
def q_power_mod(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.power_mod(F.col("p_partkey"), F.col("p_size")).alias("v"))
