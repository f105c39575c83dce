"""Text, lexicon, likelihood and stylometry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import comments, conversations as C, likelihood as L, packed
from quillstone.plans.lexicons import AI_PATTERNS, ANCHORS, FINANCE, HEDGES, INSULTS, STEMS, VALUED
from quillstone.plans.registry import listed, query, sql_list, sql_values, table
from quillstone.sources.shared import materialize

#: Letters and digits beyond ASCII as underscores: what the SQL engine's ASCII word boundaries then take for letters.
PLAIN = r"regexp_replace(text, '[^\P{L}\x00-\x7F]|[^\P{N}\x00-\x7F]', '_', 'g')"
EN = f"en AS (SELECT doc_id, text, {PLAIN} AS u FROM documents)"
TOK = EN + r""",
tok AS (SELECT doc_id, lower(t) AS token, pos FROM (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS pos
        FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS l FROM en)))"""
STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
SENT = rf"string_split(regexp_replace({STRIP}, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31))"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments.token_table(documents(spark, sf_dir))


def valued(spark: SparkSession) -> DataFrame:
    return listed(spark, VALUED, "word string, valence double, arousal double")


def words(spark: SparkSession, values, name: str = "word") -> DataFrame:
    return listed(spark, [(v,) for v in values], f"{name} string")


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


@query(r"""SELECT doc_id, len(l)::INT AS n_tokens, len(list_distinct(list_transform(l, lambda x: lower(x))))::INT AS n_types
FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS l FROM documents)""")
def q_tokens(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_types"))


@query(rf"""SELECT doc_id, len(list_filter(s, lambda x: x <> ''))::INT AS n_any, len(list_filter(s, lambda x: length(x) > 3))::INT AS n_long,
len(list_filter(s, lambda x: trim(x) <> ''))::INT AS n_stripped, greatest(1, len(regexp_extract_all(text, '[.!?]+')) + (length(text) > 0 AND right(text, 1) NOT IN ('.', '!', '?'))::INT)::INT AS n_runs,
greatest(1, len(string_split_regex({STRIP}, '[.!?]+')))::INT AS n_pieces FROM (SELECT doc_id, text, {SENT} AS s FROM documents)""")
def q_sentences(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(T.sentences(t)).alias("n_any"), F.size(T.sentences(t, "over_three")).alias("n_long"), F.size(T.sentences(t, "stripped")).alias("n_stripped"), T.n_sentences(t).alias("n_runs"), T.n_sentence_pieces(t).alias("n_pieces")
    )


@query(rf"""WITH s AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, list_filter({SENT}, lambda x: x <> '') AS l FROM documents)),
w AS (SELECT *, len(list_filter(string_split_regex(regexp_replace(s, '^\s+|\s+$', '', 'g'), '\s+'), lambda x: x <> '')) AS n FROM s),
r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM w),
g AS (SELECT doc_id, string_agg(CASE WHEN run <= 120 THEN s WHEN k = 1 THEN array_to_string(string_split_regex(s, '\s+')[1:120], ' ') END, ' ' ORDER BY k) AS out,
      sum(CASE WHEN run <= 120 THEN n WHEN k = 1 THEN 120 ELSE 0 END) AS n FROM r WHERE run <= 120 OR k = 1 GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN g.n >= 8 THEN md5(g.out) END AS digest FROM documents d LEFT JOIN g USING (doc_id)""")
def q_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.truncated(F.col("text"))).alias("digest"))


_N = "greatest(1, len(regexp_extract_all(text, '[.!?]+')) + (length(text) > 0 AND right(text, 1) NOT IN ('.', '!', '?'))::INT)"
_OCC = lambda x: f"((length(text) - length(replace(text, '{x}', ''))) / {len(x)})"
_RATES = {
    "em_dash": f"{_OCC('—')} / {_N}", "en_dash": f"{_OCC('–')} / {_N}", "semicolon": f"{_OCC(';')} / {_N}", "ellipsis": f"({_OCC('...')} + {_OCC('…')}) / {_N}",
    "oxford_comma": rf"len(regexp_extract_all(u, ',\s+and\b')) / {_N}", "multi_excl": f"len(regexp_extract_all(text, '!{{2,}}')) / {_N}", "multi_quest": rf"len(regexp_extract_all(text, '\?{{2,}}')) / {_N}",
    "all_caps_run": rf"len(regexp_extract_all(u, '\b[A-Z]{{3,}}\b')) / {_N}", "double_space": f"{_OCC('  ')} / greatest(1, length(text))", "smart_quote": f"({_OCC('‘')} + {_OCC('’')} + {_OCC('“')} + {_OCC('”')}) / greatest(1, length(text))",
}


@query(f"WITH {EN} SELECT doc_id, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in _RATES.items()) + " FROM en")
def q_punct_rates(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", *[F.round(v, 6).alias(k) for k, v in T.punctuation_rates(F.col("text")).items()])


_LONG = f"{EN}, r AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS pattern, {v} AS rate FROM en WHERE regexp_matches(text, '\\S')" for k, v in _RATES.items()) + ")"


@query(f"WITH {_LONG} SELECT pattern, round(avg(rate), 6) AS mu, round(stddev_pop(rate) + 1e-6, 6) AS sigma FROM r GROUP BY pattern")
def q_punct_baseline(spark, sf_dir):
    return comments.punctuation_baseline(comments.punctuation_wide(documents(spark, sf_dir))).select("pattern", *r6("mu", "sigma"))


@query(f"WITH {_LONG}, b AS (SELECT pattern, avg(rate) AS mu, stddev_pop(rate) + 1e-6 AS sigma FROM r GROUP BY pattern) SELECT doc_id, round(avg(abs(rate - mu) / sigma), 6) AS regularity FROM r JOIN b USING (pattern) GROUP BY doc_id")
def q_punct_regularity(spark, sf_dir):
    rates = comments.punctuation_wide(documents(spark, sf_dir))
    return comments.punctuation_regularity(rates, comments.punctuation_baseline(rates)).select("doc_id", *r6("regularity"))


@query("SELECT c_custkey, 'U' || substr(sha256('pepper' || c_name), 1, 10) AS user_hash FROM customer")
def q_user_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.user_hash(F.col("c_name"), "pepper").alias("user_hash"))


LEX = f"lex(word, v, a) AS (VALUES {sql_values(VALUED)})"
AFF = """aff AS (SELECT doc_id, count(*) AS n, count(v) AS hits, CASE WHEN count(v) >= 2 THEN avg(v) END AS mv, CASE WHEN count(v) >= 2 THEN avg(a) END AS ma,
        CASE WHEN count(v) >= 2 THEN count(*) FILTER (WHERE v < -0.5) / count(*) END AS neg FROM tok LEFT JOIN lex ON word = token GROUP BY doc_id)"""


@query(f"WITH {TOK}, {LEX}, {AFF} SELECT doc_id, n AS n_tokens, hits, round(ma * abs(mv), 6) AS arousal_intensity, round(neg, 6) AS negative_share FROM aff")
def q_affect(spark, sf_dir):
    s = comments.affect(document_tokens(spark, sf_dir), valued(spark))
    return s.select("doc_id", "n_tokens", "hits", F.round(comments.arousal_intensity(s), 6).alias("arousal_intensity"), *r6("negative_share"))


@query(f"WITH {TOK}, st(stem) AS (VALUES {sql_values([(s,) for s in STEMS])}) SELECT doc_id, round(avg((EXISTS (SELECT 1 FROM st WHERE length(stem) >= 4 AND starts_with(token, stem)))::INT), 6) AS prefix_share FROM tok GROUP BY doc_id")
def q_vice_prefix(spark, sf_dir):
    return comments.prefix_share(document_tokens(spark, sf_dir), words(spark, STEMS, "stem")).select("doc_id", *r6("prefix_share"))


@query(f"""WITH {TOK}, w AS (SELECT doc_id, token, avg((token IN ({sql_list(INSULTS)}))::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS s FROM tok)
SELECT doc_id, round(avg(s), 6) AS association FROM w WHERE token IN ({sql_list(ANCHORS)}) GROUP BY doc_id""")
def q_outgroup_window(spark, sf_dir):
    return comments.neighbourhood_share(document_tokens(spark, sf_dir), words(spark, ANCHORS), words(spark, INSULTS)).select("doc_id", *r6("association"))


_RQ = "(?i)^(" + "|".join(f"(?:{p})" for p in T.QUESTION_OPENERS) + ")"
_Q = lambda s: s.replace("'", "''")


@query(rf"""WITH {EN}, s AS (SELECT doc_id, text, u, list_filter({SENT}, lambda x: x <> '') AS l, greatest(1, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'))) AS t FROM en)
SELECT doc_id, CASE WHEN regexp_matches(text, '\S') THEN round(len(list_filter(l, lambda x: x LIKE '%?' AND regexp_matches(x, '{_Q(_RQ)}'))) / greatest(1, len(l)) + len(regexp_extract_all(u, '{_Q(T.HYPERBOLE)}')) / greatest(1, len(l))
 + len(regexp_extract_all(u, '\b[A-Z]{{3,}}\b')) / t + len(regexp_extract_all(text, '!')) / greatest(1, len(l)), 6) END AS rhetoric FROM s""")
def q_rhetoric(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.round(T.rhetoric(F.col("text")), 6).alias("rhetoric"))


_HITS = lambda ps: "(" + " + ".join(f"regexp_matches(u, '(?i){_Q(p)}')::INT" for p in ps) + ")"
_NT = r"greatest(1, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')))"


@query(f"WITH {EN} SELECT doc_id, round(ln(1 + {_HITS(AI_PATTERNS)} / ({_NT} / 20.0)), 6) AS fingerprint FROM en")
def q_ai_phrases(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.round(comments.fingerprint(F.col("text"), AI_PATTERNS), 6).alias("fingerprint"))


@query(f"WITH {EN} SELECT doc_id, round({_HITS(HEDGES)} / ({_NT} / 100.0), 6) AS hedging FROM en")
def q_hedges(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.round(comments.hedging(F.col("text"), HEDGES), 6).alias("hedging"))


@query(rf"""WITH {TOK}, {LEX}, {AFF}, i AS (SELECT doc_id, (list_sum(list_transform(list_filter(string_split(regexp_replace(u, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: x <> ''),
 lambda s: len(regexp_extract_all(substr(s, 2), '\b[A-Z][a-z]+\b')) - regexp_matches(substr(s, 2), '^[A-Z][a-z]+\b')::INT + len(regexp_extract_all(s, '\b[A-Z][a-z]+\s+[A-Z][a-z]+\b'))))
 + len(regexp_extract_all(u, '\b\d[\d.,]*\b')) + len(regexp_extract_all(text, '["“][^"“”]{{3,}}["”]'))) / len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS info,
 len(regexp_extract_all(text, '!')) / greatest(1, len(string_split_regex({STRIP}, '[.!?]+'))) AS ex FROM en)
SELECT doc_id, round(ln((ma * (abs(mv) + ex) + 1e-3) / (info + 1e-3)), 6) AS affect_ratio FROM i JOIN aff USING (doc_id)""")
def q_info_affect(spark, sf_dir):
    en = documents(spark, sf_dir)
    return comments.affect_to_information(en, comments.affect(comments.token_table(en), valued(spark))).select("doc_id", *r6("affect_ratio"))


@query()
def q_neutralize(spark, sf_dir):
    return comments.neutralization_gap(documents(spark, sf_dir), [w for w, v, a in VALUED if abs(v) >= 0.5 and a >= 0.6]).select("doc_id", *r6("length_ratio", "neutralization_gap"))


@query(f"""WITH {TOK}, c AS (SELECT doc_id, token, pos, lag(pos, 1, -1) OVER (PARTITION BY doc_id, token ORDER BY pos) AS b, count(*) OVER (PARTITION BY doc_id) AS n FROM tok)
SELECT doc_id, round(CASE WHEN first(n) < 100 THEN count(*) FILTER (WHERE b < 0) / first(n) ELSE sum(greatest(0, least(pos, n - 100) - greatest(0, pos - 99, b + 1) + 1)) / (100 * (first(n) - 99)) END, 6) AS mattr FROM c GROUP BY doc_id""")
def q_mattr(spark, sf_dir):
    return C.moving_ttr(document_tokens(spark, sf_dir)).select("doc_id", *r6("mattr"))


@query(f"WITH {TOK}, c AS (SELECT doc_id, token, count(*) AS c FROM tok GROUP BY ALL) SELECT doc_id, round(1e4 * (sum(c * c) - sum(c)) / (sum(c) * sum(c)), 6) AS yule_k FROM c GROUP BY doc_id")
def q_yule_k(spark, sf_dir):
    return C.yule_k(C.type_counts(document_tokens(spark, sf_dir))).select("doc_id", *r6("yule_k"))


@query(f"""WITH {TOK}, c AS (SELECT doc_id, token, count(*) AS c FROM tok GROUP BY ALL),
r AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, token) AS r, sum(c) OVER (PARTITION BY doc_id) AS n, count(*) OVER (PARTITION BY doc_id) AS k FROM c),
s AS (SELECT doc_id, regr_slope(ln(c), ln(r)) AS s FROM r WHERE n >= 150 AND (CASE WHEN least(k, 1000) - 10 >= 2 THEN r BETWEEN 10 AND 1000 ELSE true END) GROUP BY doc_id)
SELECT d.doc_id, round(abs(-s - 1), 6) AS zipf_deviation FROM (SELECT DISTINCT doc_id FROM c) d LEFT JOIN s USING (doc_id)""")
def q_zipf(spark, sf_dir):
    return C.zipf_deviation(C.type_counts(document_tokens(spark, sf_dir))).select("doc_id", *r6("zipf_deviation"))


@query(f"""WITH {TOK}, h AS (SELECT doc_id, token, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) >= count(*) OVER (PARTITION BY doc_id) // 2 AS late FROM tok),
c AS (SELECT doc_id, token, count(*) FILTER (WHERE late) AS l, count(*) FILTER (WHERE NOT late) AS e FROM h GROUP BY ALL),
t AS (SELECT *, sum(l) OVER (PARTITION BY doc_id) AS nl, sum(e) OVER (PARTITION BY doc_id) AS ne, count(*) OVER (PARTITION BY doc_id) AS v FROM c)
SELECT doc_id, CASE WHEN first(nl) > 0 AND first(ne) > 0 THEN round(sum((l + 0.5) / (nl + 0.5 * v) * ln(((l + 0.5) / (nl + 0.5 * v)) / ((e + 0.5) / (ne + 0.5 * v)))), 6) END AS topic_shift,
CASE WHEN first(nl) > 0 AND first(ne) > 0 THEN round(sum(CASE WHEN token IN ({sql_list(FINANCE)}) THEN l ELSE 0 END) / first(nl), 6) END AS late_mass FROM t GROUP BY doc_id""")
def q_topic_shift(spark, sf_dir):
    marked = C.halves(document_tokens(spark, sf_dir), "doc_id", "pos")
    return C.topic_shift(marked, "doc_id", words(spark, FINANCE)).select("doc_id", *r6("topic_shift", "late_mass"))


_BI = f"""{TOK}, p AS (SELECT doc_id, pos, token, coalesce(lag(token) OVER (PARTITION BY doc_id ORDER BY pos), '') AS prev FROM tok),
bi AS (SELECT prev, token, count(*) AS n FROM p GROUP BY ALL), bp AS (SELECT *, sum(n) OVER (PARTITION BY prev) AS np, rank() OVER (PARTITION BY prev ORDER BY n DESC) AS rk FROM bi),
sc AS (SELECT doc_id, pos, ln((n + 0.1) / (np + 0.1 * 5000)) AS lp, rk FROM p JOIN bp USING (prev, token)),
pp AS (SELECT doc_id, count(*) AS n_tokens, exp(-avg(lp)) AS pp FROM sc GROUP BY doc_id)"""


def document_pairs(spark: SparkSession, sf_dir: str, back: int = 1) -> DataFrame:
    """Tokens with those before them, written out."""
    return materialize(comments.pair_table(documents(spark, sf_dir), back=back), "pairs")


def scored(spark, sf_dir, ranks: bool = False):
    return L.own_scores(document_pairs(spark, sf_dir), 5000, ranks=ranks)


@query(f"WITH {_BI} SELECT doc_id, n_tokens, round(pp, 4) AS perplexity FROM pp")
def q_bigram_perplexity(spark, sf_dir):
    return L.perplexity(scored(spark, sf_dir)).select("doc_id", "n_tokens", F.round("perplexity", 4).alias("perplexity"))


@query(f"WITH {_BI} SELECT doc_id, CASE WHEN count(*) > 1 THEN round(count(*) FILTER (WHERE pos > 0 AND rk <= 10) / (count(*) - 1), 6) END AS top10_share, CASE WHEN count(*) > 1 THEN round(count(*) FILTER (WHERE pos > 0 AND rk <= 100) / (count(*) - 1), 6) END AS top100_share FROM sc GROUP BY doc_id")
def q_rank_share(spark, sf_dir):
    return L.rank_shares(scored(spark, sf_dir, ranks=True)).select("doc_id", *r6("top10_share", "top100_share"))


_LB = f"""{_BI}, lb AS (SELECT ((n_tokens // 10) * 10 + 5)::INT AS center, avg(ln(pp)) AS mu, stddev_pop(ln(pp)) + 1e-6 AS sigma FROM pp WHERE n_tokens >= 4 AND pp > 1 GROUP BY 1 HAVING count(*) >= 5)"""


@query(f"WITH {_LB} SELECT center, round(mu, 6) AS mu, round(sigma, 6) AS sigma FROM lb")
def q_length_baseline(spark, sf_dir):
    return L.length_baseline(L.perplexity(scored(spark, sf_dir))).select("center", *r6("mu", "sigma"))


@query(f"""WITH {_LB}, m AS (SELECT doc_id, pp, mu, sigma, row_number() OVER (PARTITION BY doc_id ORDER BY abs(center - n_tokens), center) AS r FROM pp, lb)
SELECT doc_id, round((ln(CASE WHEN pp > 1 THEN pp END) - mu) / sigma, 5) AS psi_1 FROM m WHERE r = 1""")
def q_nearest_bucket(spark, sf_dir):
    pp = L.perplexity(scored(spark, sf_dir))
    near = L.nearest_bucket(pp, L.length_baseline(pp).withColumn("ord", F.col("center")))
    return near.select("doc_id", F.round(L.normalized_perplexity(F.col("perplexity"), F.col("mu"), F.col("sigma")), 5).alias("psi_1"))


@query(rf"""WITH {EN}, s AS (SELECT doc_id, length(unnest(list_filter({SENT}, lambda x: length(x) > 3))) AS n FROM en),
b AS (SELECT doc_id, count(*) AS k, stddev_pop(n) AS s, avg(n) AS m FROM s GROUP BY doc_id)
SELECT doc_id, CASE WHEN k >= 2 THEN round((s - m) / (s + m), 6) END AS burstiness FROM b""")
def q_burstiness(spark, sf_dir):
    s = documents(spark, sf_dir).select("doc_id", F.explode(T.sentences(F.col("text"), "over_three")).alias("s")).select("doc_id", F.length("s").alias("n"))
    return L.burstiness(s, "doc_id", "n").select("doc_id", *r6("burstiness"))


def curvature_sql(tokens: str, copies: int, name: str = "doc_id", key: str = "doc_id") -> str:
    """Tables co (log probabilities of the copies) and cu (curvature by `key`) over the pairs p and the model bp of `tokens`."""
    return f"""{tokens}, be AS (SELECT prev, arg_max(token, (n, token)) AS fill FROM bi GROUP BY prev),
p2 AS (SELECT *, coalesce(lag(prev) OVER (PARTITION BY {key} ORDER BY pos), '') AS prev2, sha256({name} || ':' || pos) AS h, coalesce(sha256({name} || ':' || (pos - 1)), '') AS hb FROM p),
fi AS (SELECT p2.{key}, pos, p2.prev, token, coalesce(a.fill, token) AS fill, CASE WHEN pos = 0 THEN '' ELSE coalesce(b.fill, p2.prev) END AS fb, h, hb FROM p2 LEFT JOIN be a ON a.prev = p2.prev LEFT JOIN be b ON b.prev = p2.prev2),
ce AS (SELECT {key}, c AS copy, CASE WHEN c > 0 AND pos > 0 AND substr(hb, 2 * c - 1, 2) < '{L.REPLACED_BELOW}' THEN fb ELSE prev END AS prev, CASE WHEN c > 0 AND substr(h, 2 * c - 1, 2) < '{L.REPLACED_BELOW}' THEN fill ELSE token END AS token FROM fi, range({copies + 1}) r(c)),
co AS (SELECT {key}, copy, round(sum(ln((coalesce(n, 0) + 0.1) / (coalesce(np, 0) + 500.0))), 9) AS lp FROM ce LEFT JOIN bp USING (prev, token) GROUP BY {key}, copy),
cu AS (SELECT {key}, CASE WHEN count(*) >= 3 THEN (max(lp) FILTER (WHERE copy = 0) - avg(lp) FILTER (WHERE copy > 0)) / CASE WHEN stddev_samp(lp) FILTER (WHERE copy > 0) > 0 THEN stddev_samp(lp) FILTER (WHERE copy > 0) ELSE 1e-8 END END AS curvature FROM co GROUP BY {key})"""


@query(f"WITH {curvature_sql(_BI, 10)} SELECT doc_id, round(curvature, 4) AS curvature FROM cu")
def q_curvature(spark, sf_dir):
    coded = packed.chunks(documents(spark, sf_dir), "doc_id", sentences=False)
    of_texts = packed.PackedBigrams.fit(coded).of_chunks(coded, "doc_id", 10)
    return L.curvature(packed.copy_scores(of_texts, "doc_id"), "doc_id").select("doc_id", F.round("curvature", 4).alias("curvature"))


CONV = "m AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'S' WHEN 'user' THEN 'V' END AS speaker, text FROM conversations)"


def messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", "S").when(F.col("role") == "user", "V").alias("speaker"), "text")


@query(rf"""WITH {CONV}, w AS (SELECT conv_id, speaker, len(list_filter(string_split_regex({STRIP}, '\s+'), lambda x: x <> '')) AS w FROM m),
g AS (SELECT conv_id, avg(w) FILTER (WHERE speaker = 'S') AS a, avg(w) FILTER (WHERE speaker = 'V') AS b FROM w GROUP BY conv_id) SELECT conv_id, round(ln((a + 1) / (b + 1)), 6) AS length_asymmetry FROM g""")
def q_length_asym(spark, sf_dir):
    return C.length_asymmetry(messages(spark, sf_dir)).select("conv_id", *r6("length_asymmetry"))


@query("""WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS gap FROM events),
s AS (SELECT user_id, count(gap)::DOUBLE AS n, skewness(gap) AS g1, kurtosis(gap) AS g2 FROM g WHERE gap > 0 GROUP BY user_id)
SELECT user_id, CASE WHEN n >= 4 THEN round((g1 * g1 + 1) / (g2 + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))), 6) END AS bimodality FROM s""")
def q_timing_bc(spark, sf_dir):
    g = C.gaps(table(spark, sf_dir, "events"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")))
    return C.bimodality(g, "user_id").select("user_id", *r6("bimodality"))


_CU = """v AS (SELECT user_id, event_id, value AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


@query(f"""WITH {_CU}, b AS (SELECT user_id, median(s) AS mu FROM v WHERE i <= greatest(2, n // 2) GROUP BY user_id),
r AS (SELECT user_id, event_id, n, sum(mu - s - 0.25) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM v JOIN b USING (user_id)),
g AS (SELECT user_id, n, run - least(0, min(run) OVER (PARTITION BY user_id ORDER BY event_id)) AS g FROM r) SELECT user_id, CASE WHEN first(n) >= 4 THEN round(max(g), 5) END AS cusum_peak FROM g GROUP BY user_id""")
def q_cusum(spark, sf_dir):
    return C.cusum_peak(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("user_id", F.round("cusum_peak", 5).alias("cusum_peak"))


@query(f"WITH {_CU} SELECT user_id, CASE WHEN count(*) >= 3 THEN round(regr_slope(s, i - 1), 6) END AS slope FROM v GROUP BY user_id")
def q_slope(spark, sf_dir):
    return C.ordinal_slope(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("user_id", *r6("slope"))


@query(rf"""WITH a AS (SELECT conv_id, turn, text, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x)) AS t, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / count(*) OVER (PARTITION BY conv_id) AS f FROM conversations WHERE role = 'assistant'),
b AS (SELECT *, len(list_filter(t, lambda x: x IN ({sql_list(C.POSITIVE)}))) AS p, len(list_filter(t, lambda x: x IN ({sql_list(C.NEGATIVE)}))) AS n, len(regexp_extract_all(text, '\?')) AS q FROM a)
SELECT conv_id, turn, ((sign(p - n) + 1)::INT + 3 * (CASE WHEN len(t) < 8 THEN 0 WHEN len(t) < 25 THEN 1 ELSE 2 END) + 9 * (len(list_filter(t, lambda x: x IN ({sql_list(FINANCE)}))) > 0)::INT
 + 18 * least(2, q) + 54 * (CASE WHEN f < 0.33 THEN 0 WHEN f < 0.66 THEN 1 ELSE 2 END))::INT AS symbol FROM b""")
def q_symbols(spark, sf_dir):
    return C.stage_symbols(messages(spark, sf_dir).where("speaker = 'S'"), FINANCE).select("conv_id", "turn", F.col("symbol").cast("int").alias("symbol"))


@query()
def q_stage_model(spark, sf_dir):
    s = C.stage_symbols(messages(spark, sf_dir).where("speaker = 'S'"), FINANCE).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "symbol"))).alias("s")).select("conv_id", F.transform("s", lambda x: x["symbol"].cast("int")).alias("symbols"))
    odd = F.size("symbols") % 2 == 1
    return C.stage_scores(s, C.fit_stages(s.where(odd), 5), C.fit_stages(s.where(~odd), 5)).select("conv_id", F.round("log_ratio", 4).alias("log_ratio"), "reaches_last")
