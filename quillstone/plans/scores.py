"""Metric, decision, set, quota and report queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import decisions as D, metrics as M, relational as R
from quillstone.plans import texts
from quillstone.plans.lexicons import INSULTS
from quillstone.plans.registry import listed, query, sql_list, sql_values, table

#: Share of insults by document, rounded to a grid so that the metrics' windows stay small.
_S = f"{texts.TOK}, sc AS (SELECT doc_id, round(least(1.0, 5.0 * avg((token IN ({sql_list(INSULTS)}))::INT)), 4) AS s, count(*) AS n FROM tok GROUP BY doc_id), x AS (SELECT doc_id, s, n, toxic AS y, quality AS q FROM sc JOIN labels USING (doc_id))"


def scored(spark, sf_dir):
    hit = F.col("token").isin(*INSULTS).cast("int")
    s = texts.document_tokens(spark, sf_dir).groupBy("doc_id").agg(F.round(F.least(F.lit(1.0), 5.0 * F.avg(hit)), 4).alias("s"), F.count("*").alias("n"))
    return s.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "s", "n", F.col("toxic").alias("y"), F.col("quality").alias("q"))


@query(f"WITH {_S} SELECT round((SELECT sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) FROM x a, x b WHERE a.y = 1 AND b.y = 0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 6) AS auc, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg FROM x")
def q_auc(spark, sf_dir):
    return M.roc_auc(scored(spark, sf_dir), "s", "y").select(F.round("auc", 6).alias("auc"), "n_pos", "n_neg")


_RUN = f"{_S}, g AS (SELECT s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM x GROUP BY s), r AS (SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g)"


@query(f"WITH {_RUN} SELECT round(sum(pos * tp / (tp + fp)) / first(p), 6) AS average_precision FROM r")
def q_average_precision(spark, sf_dir):
    return M.average_precision(scored(spark, sf_dir), "s", "y").select(F.round("average_precision", 6).alias("average_precision"))


@query(f"WITH {_RUN} SELECT s AS threshold, round(tp / p, 6) AS tpr, round(fp / n, 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM r")
def q_roc_points(spark, sf_dir):
    return M.curve_points(scored(spark, sf_dir), "s", "y").select("threshold", *texts.r6("tpr", "fpr", "precision"))


@query(f"WITH {_S}, b AS (SELECT floor(s * 10) AS k, count(*) AS n, avg(s) AS mp, avg(y) AS my FROM x GROUP BY 1) SELECT round(sum(CASE WHEN k < 10 THEN n * abs(mp - my) END) / sum(n), 6) AS ece FROM b")
def q_ece(spark, sf_dir):
    return M.calibration_error(scored(spark, sf_dir), "s", "y").select(F.round("ece", 6).alias("ece"))


@query(f"WITH {_S}, e AS (SELECT quantile_cont(n, [{', '.join(str(k / 10) for k in range(1, 10))}]) AS e FROM x) SELECT len(list_filter(e, lambda v: v < n))::INT AS bin, count(*) AS n, round(avg(x.n), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM x, e GROUP BY 1")
def q_quantile_calibration(spark, sf_dir):
    return M.reliability(scored(spark, sf_dir).select(F.col("n").cast("double").alias("p"), "y"), "p", "y").select("bin", "n", *texts.r6("mean_p", "mean_y"))


_GAPPY = "gappy AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value END AS a, CASE WHEN event_id % 5 > 0 THEN event_id % 7 END AS b, event_type FROM events)"


def gappy(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 5 > 0, (F.col("event_id") % 7).cast("double")).alias("b"), "event_type")


@query(f"WITH {_GAPPY} SELECT event_id, round(coalesce(a, (SELECT median(a) FROM gappy)), 6) AS a, round(coalesce(b, (SELECT median(b) FROM gappy)), 6) AS b FROM gappy")
def q_median_impute(spark, sf_dir):
    return M.imputed(gappy(spark, sf_dir), ["a", "b"]).select("event_id", *texts.r6("a", "b"))


@query(f"WITH {_GAPPY} SELECT event_id, round((a - (SELECT avg(a) FROM gappy)) / (SELECT stddev_pop(a) FROM gappy), 6) AS a FROM gappy")
def q_standardize(spark, sf_dir):
    return M.standardized(gappy(spark, sf_dir), ["a"]).select("event_id", *texts.r6("a"))


@query(f"WITH {_GAPPY} SELECT round(avg((a IS NULL)::INT), 6) AS a, round(avg((b IS NULL)::INT), 6) AS b FROM gappy")
def q_missing_fraction(spark, sf_dir):
    return M.missing_fractions(gappy(spark, sf_dir), ["a", "b"]).select(*texts.r6("a", "b"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def q_label_cells(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query(f"WITH {_S} SELECT y, round(avg(s), 6) AS s, round(avg(n), 6) AS n FROM x GROUP BY y")
def q_class_means(spark, sf_dir):
    return M.class_means(scored(spark, sf_dir), ["s", "n"], "y").select("y", *texts.r6("s", "n"))


@query(f"WITH {_S}, m AS (SELECT avg(s) FILTER (WHERE y = 1) AS a, avg(s) FILTER (WHERE y = 0) AS b, avg(n) FILTER (WHERE y = 1) AS c, avg(n) FILTER (WHERE y = 0) AS d FROM x) SELECT 's' AS feature, round(a, 6) AS mean_pos, round(b, 6) AS mean_neg, sign(a - b) = 1 AS ok FROM m UNION ALL SELECT 'n', round(c, 6), round(d, 6), sign(c - d) = 1 FROM m")
def q_direction(spark, sf_dir):
    return M.direction_check(scored(spark, sf_dir), {"s": 1, "n": 1}, "y").select("feature", *texts.r6("mean_pos", "mean_neg"), "ok")


@query("WITH m AS (SELECT event_type, avg(value) AS mean_value, count(*)::DOUBLE AS n FROM events GROUP BY 1), l AS (SELECT 'mean_value' AS feature, event_type, mean_value AS v FROM m UNION ALL SELECT 'n', event_type, n FROM m) SELECT feature, round(max(v) FILTER (WHERE event_type = 'click'), 6) AS click, round(max(v) FILTER (WHERE event_type = 'error'), 6) AS error FROM l GROUP BY feature")
def q_feature_pivot(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("mean_value"), F.count("*").alias("n"))
    return M.feature_pivot(m, "event_type", ["mean_value", "n"], ["click", "error"]).select("feature", *texts.r6("click", "error"))


def _flag_values(rules) -> list[tuple[str, int, float, float, int]]:
    """feature, modulus, divisor, shift and digits: values on both sides of each rule's bound, on it, and missing ones (each eleventh)."""
    return [(name, 7 + 2 * k, abs(bound) / 3 or 1.0, bound, k % 3) for k, (name, _, bound, _) in enumerate(rules)]


def _flag_sql(rules) -> str:
    value = ", ".join(f"CASE WHEN (event_id + {rest}) % 11 > 0 THEN round({shift} + ((event_id + {rest}) % {m} - 3) * {d!r}, 4) END AS {name}" for name, m, d, shift, rest in _flag_values(rules))
    said = lambda name, message: f"printf('{message.replace(chr(39), chr(39) * 2)}', {name})" if "%" in message else "'" + message.replace("'", "''") + "'"
    rows = ", ".join(f"CASE WHEN {name} {way} {bound} THEN {said(name, message)} END" for name, way, bound, message in rules)
    return f"WITH f AS (SELECT event_id, {value} FROM events) SELECT event_id, list_filter([{rows}], lambda x: x IS NOT NULL) AS flags FROM f"


def _flagged(spark, sf_dir, rules):
    i = F.col("event_id")
    values = [F.when((i + rest) % 11 > 0, F.round(F.lit(shift) + ((i + rest) % m - 3) * F.lit(d), 4)).alias(name) for name, m, d, shift, rest in _flag_values(rules)]
    f = table(spark, sf_dir, "events").select("event_id", *values)
    return f.select("event_id", D.red_flags(rules, f.columns).alias("flags"))


@query(_flag_sql(D.COMMENT_FLAGS))
def q_red_flags(spark, sf_dir):
    """All rules for comments."""
    return _flagged(spark, sf_dir, D.COMMENT_FLAGS)


@query(_flag_sql(D.CONVERSATION_FLAGS))
def q_conversation_flags(spark, sf_dir):
    """All rules for conversations."""
    return _flagged(spark, sf_dir, D.CONVERSATION_FLAGS)


_P = "p AS (SELECT event_id, round((event_id % 101) / 100, 2) AS a, round((event_id % 37) / 36, 4) AS r FROM events)"


@query(f"""WITH {_P} SELECT event_id, CASE WHEN a >= 0.5 AND r >= 0.5 THEN 'ai_ragebait' WHEN a >= 0.5 THEN 'ai_only' WHEN r >= 0.5 THEN 'human_ragebait' ELSE 'benign' END AS verdict,
CASE WHEN a < 0.25 THEN 'green' WHEN a < 0.5 THEN 'amber' ELSE 'red' END AS light, CASE WHEN r >= 0.6 THEN 1 WHEN r < 0.1 THEN 0 END AS band FROM p""")
def q_verdict(spark, sf_dir):
    p = table(spark, sf_dir, "events").select("event_id", F.round((F.col("event_id") % 101) / 100, 2).alias("a"), F.round((F.col("event_id") % 37) / 36, 4).alias("r"))
    return p.select("event_id", D.verdict(F.col("a"), F.col("r")).alias("verdict"), D.light(F.col("a")).alias("light"), D.band_label(F.col("r"), 0.6).alias("band"))


@query("SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 400 WHEN length(text) > 4000 THEN 413 WHEN doc_id % 50 = 0 THEN 503 ELSE 200 END AS status FROM documents")
def q_validation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", D.request_status(F.col("text"), F.col("doc_id") % 50 != 0).alias("status"))


@query("SELECT c_custkey, trim(split_part('10.0.0.' || c_custkey || ', 192.168.0.1', ',', 1)) AS address FROM customer")
def q_first_address(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", D.first_address(F.concat(F.lit("10.0.0."), F.col("c_custkey"), F.lit(", 192.168.0.1"))).alias("address"))


@query("WITH s AS (SELECT user_id, count(*) AS n, avg(least(1.0, value / 100)) AS m, sum(least(1.0, value / 100)) AS s FROM events GROUP BY 1) SELECT user_id, n, round(m, 6) AS mean_score, round(1 / (1 + exp(-(ln(0.05 / 0.95) + s * ln(0.8 * 0.9 / (0.1 * 0.2))))), 6) AS posterior FROM s")
def q_account_posterior(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("score", F.least(F.lit(1.0), F.col("value") / 100))
    return D.account_posterior(e, "user_id", "score").select("user_id", "n", *texts.r6("mean_score", "posterior"))


@query("WITH c AS (SELECT count(*) FILTER (WHERE quality = 0 AND toxic = 0) >= 30 AS enough FROM labels) SELECT doc_id FROM labels, c WHERE CASE WHEN enough THEN quality = 0 AND toxic = 0 ELSE quality = 0 OR toxic = 0 END")
def q_benign(spark, sf_dir):
    return D.benign(table(spark, sf_dir, "labels"), "quality", "toxic").select("doc_id")


@query("SELECT text, 'document' AS kind, NULL AS role FROM documents UNION ALL SELECT text, 'turn', role FROM conversations UNION ALL SELECT text, 'item', NULL FROM benchmark")
def q_merge_union(spark, sf_dir):
    t = lambda n, k, *c: table(spark, sf_dir, n).select("text", *c).withColumn("kind", F.lit(k))
    return R.union_all([t("documents", "document"), t("conversations", "turn", "role"), t("benchmark", "item")])


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def q_dedup_ci(spark, sf_dir):
    return R.dedup_ignoring_case(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "source")


@query("SELECT DISTINCT md5(text) AS digest FROM documents")
def q_dedup_exact(spark, sf_dir):
    return table(spark, sf_dir, "documents").dropDuplicates(["text"]).select(F.md5("text").alias("digest"))


@query("SELECT url, min(page_id) AS ord FROM (SELECT regexp_replace(url, '[?].*$', '') AS url, page_id FROM pages) GROUP BY url")
def q_url_dedup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.regexp_replace("url", "[?].*$", "").alias("url"), "page_id").groupBy("url").agg(F.min("page_id").alias("ord"))


@query("SELECT doc_id, toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS r FROM labels WHERE toxic IS NOT NULL) WHERE r <= 25")
def q_class_quota(spark, sf_dir):
    return R.class_quota(table(spark, sf_dir, "labels"), "toxic", "doc_id", 25).select("doc_id", "toxic")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_seen_anti(spark, sf_dir):
    return R.unseen(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation) AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def q_two_anti(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    left = R.unseen(s, n.select(F.col("n_nationkey").cast("long").alias("s_suppkey")), "s_suppkey")
    return R.unseen(left, n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey")), "s_nationkey").select("s_suppkey", "s_nationkey")


@query("SELECT o_orderstatus, o_orderpriority, count(*) FILTER (WHERE o_totalprice > 150000) AS passed, count(*) AS total, grouping(o_orderstatus, o_orderpriority) AS level, round(100.0 * count(*) FILTER (WHERE o_totalprice > 150000) / count(*), 6) AS percent FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def q_rollup_report(spark, sf_dir):
    return R.rollup_report(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", F.col("o_totalprice") > 150000).select("o_orderstatus", "o_orderpriority", "passed", "total", "level", *texts.r6("percent"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderstatus <> 'P', o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def q_best_by(spark, sf_dir):
    return R.best_by(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", [(F.col("o_orderstatus") != "P").alias("ok"), F.col("o_totalprice"), F.col("o_orderkey").alias("ord")])


@query("SELECT p_brand, row_number() OVER (ORDER BY (p_brand NOT LIKE '%1')::INT, p_brand) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def q_group_order(spark, sf_dir):
    last = (~F.col("p_brand").endswith("1")).cast("int")
    return R.group_order(table(spark, sf_dir, "part"), "p_brand", last)


@query(r"SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) AS word FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM conversations)")
def q_vocab_union(spark, sf_dir):
    w = lambda n: table(spark, sf_dir, n).select(F.explode(T.tokens(F.col("text"))).alias("word"))
    return w("benchmark").union(w("conversations")).distinct()


@query("SELECT p_brand, p_type FROM part WHERE p_size > 25 INTERSECT SELECT p_brand, p_type FROM part WHERE p_size <= 25")
def q_set_intersect(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.where("p_size > 25").select("p_brand", "p_type").intersect(p.where("p_size <= 25").select("p_brand", "p_type"))


@query("SELECT p_brand, p_type FROM part WHERE p_size > 25 EXCEPT SELECT p_brand, p_type FROM part WHERE p_size <= 10")
def q_set_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.where("p_size > 25").select("p_brand", "p_type").subtract(p.where("p_size <= 10").select("p_brand", "p_type"))


@query("SELECT a.s_suppkey AS a, b.n_nationkey AS b FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey DESC) AS r FROM supplier) a JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation) b USING (r)")
def q_positional_zip(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), (-F.col("s_suppkey")).alias("oa"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("b"), F.col("n_nationkey").alias("ob"))
    return R.positional_zip(s, n, "oa", "ob").select("a", "b")


@query("""WITH l AS (SELECT 'case/' || p_partkey || '.in' AS path FROM part WHERE p_size % 2 = 0), r AS (SELECT 'case/' || p_partkey || '.out' AS path FROM part WHERE p_size % 3 = 0)
SELECT regexp_extract(l.path, '^(.*)[.][^./]*$', 1) AS stem, l.path AS left_path, r.path AS right_path FROM l JOIN r ON regexp_extract(l.path, '^(.*)[.][^./]*$', 1) = regexp_extract(r.path, '^(.*)[.][^./]*$', 1)""")
def q_stem_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = lambda ext: F.concat(F.lit("case/"), F.col("p_partkey"), F.lit(ext)).alias("path")
    return R.paired_by_stem(p.where("p_size % 2 = 0").select(name(".in")), p.where("p_size % 3 = 0").select(name(".out")), "path")


@query("SELECT c_custkey, CASE WHEN regexp_matches(lower(c_name), '^.*[0-9]+$') THEN 'customer_' || regexp_extract(lower(c_name), '([0-9]+)$', 1) END AS slug FROM customer")
def q_slug(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.slug(F.col("c_name")).alias("slug"))


_NEAR = "abs(got[i + 1].x - want[p[i + 1]].x) <= 1 AND abs(got[i + 1].y - want[p[i + 1]].y) <= 1"


@query(f"""WITH c AS (SELECT event_id, [{{'x': 1 + event_id % 3, 'y': 10}}, {{'x': 10, 'y': 11}}, {{'x': 0, 'y': 1}}, {{'x': 9, 'y': event_id % 2}}] AS got, [{{'x': 0, 'y': 0}}, {{'x': 0, 'y': 10}}, {{'x': 10, 'y': 0}}, {{'x': 10, 'y': 10}}] AS want FROM events),
o AS (SELECT [a, b, c, d] AS p FROM range(1, 5) t(a), range(1, 5) u(b), range(1, 5) v(c), range(1, 5) w(d) WHERE len(list_distinct([a, b, c, d])) = 4)
SELECT event_id, bool_or(len(list_filter(range(4), lambda i: {_NEAR})) = 4) AS ok FROM c, o GROUP BY event_id""")
def q_corner_match(spark, sf_dir):
    """Four corners in any order against the true ones, some of them a pixel too far off."""
    i = F.col("event_id")
    p = lambda x, y: F.struct(F.lit(x).cast("int").alias("x") if isinstance(x, int) else x.cast("int").alias("x"), F.lit(y).cast("int").alias("y") if isinstance(y, int) else y.cast("int").alias("y"))
    got = F.array(p(1 + i % 3, 10), p(10, 11), p(0, 1), p(9, i % 2))
    want = F.array(p(0, 0), p(0, 10), p(10, 0), p(10, 10))
    return table(spark, sf_dir, "events").select("event_id", R.corners_match(got, want).alias("ok"))
