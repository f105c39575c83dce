"""The wide feature rows as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import backends, comments, conversations as C, decisions as D, features, likelihood as L, models
from quillstone.plans import texts
from quillstone.plans.lexicons import AI_PATTERNS, ANCHORS, FINANCE, HEDGES, INSULTS, STEMS, VALUED
from quillstone.plans.registry import ORACLE, query, sql_list, table
from quillstone.sources.shared import materialize

STRONG = [w for w, v, a in VALUED if abs(v) >= 0.5 and a >= 0.6]


def lexicons(spark, sf_dir) -> features.Lexicons:
    return features.Lexicons(
        valued=texts.valued(spark), stems=texts.words(spark, STEMS, "stem"), anchors=texts.words(spark, ANCHORS), negative=texts.words(spark, INSULTS), finance=FINANCE, ai_patterns=AI_PATTERNS, hedges=HEDGES,
        strong_words=STRONG, templates=table(spark, sf_dir, "benchmark").select("text"),
    )


def fitted_stages(messages) -> tuple[C.StageModel, C.StageModel]:
    """The two stage models; conversations have no label here, so their own messages' even or odd number stands for it."""
    own = C.stage_symbols(messages.where("speaker = 'S'"), FINANCE).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "symbol"))).alias("s"))
    # written out: each round of both fits reads it
    symbols = materialize(own.select("conv_id", F.transform("s", lambda x: x["symbol"].cast("int")).alias("symbols")), "stage-symbols")
    odd = F.size("symbols") % 2 == 1
    return C.fit_stages(symbols.where(odd), 5), C.fit_stages(symbols.where(~odd), 5)


def rounded(out, digits: dict[str, int]):
    key, *columns = out.columns
    return out.select(key, *[F.round(c, digits.get(c, 6)).alias(c) for c in columns])


@query()
def q_comment_features(spark, sf_dir):
    """All 18 columns with a topic model, which SQL cannot fit."""
    docs, lex = texts.documents(spark, sf_dir), lexicons(spark, sf_dir)
    lex.topic_model = features.fitted_topics
    return rounded(features.comment_features(docs, lex), {"psi_1": 5, "psi_2": 5, "psi_3": 4})


def timed_messages(spark, sf_dir):
    return texts.messages(spark, sf_dir).withColumn("timestamp", F.timestamp_seconds(1_700_000_000 + F.col("conv_id") * 7 + F.col("turn") * F.col("turn") * 60))


@query()
def q_conversation_features(spark, sf_dir):
    """All 19 columns with stage models, which SQL cannot fit."""
    m = timed_messages(spark, sf_dir)
    lex = lexicons(spark, sf_dir)
    lex.stage_models = fitted_stages(m)
    return rounded(features.conversation_features(m, lex), {"phi_1": 4, "phi_2": 5, "phi_3": 4})


# SQL of the parts of a row.  Each is a table expression that brings its own tables.


def sub(tables: str, select: str) -> str:
    return f"(WITH {tables} {select})"


_LN_BIGRAM = "ln((coalesce(bp.n, 0) + 0.1) / (coalesce(np, 0) + 500.0))"


def sentences_sql(tables: str, group: str, log_p: str = _LN_BIGRAM, model: str = "LEFT JOIN bp USING (prev, token)") -> str:
    """Burstiness of ln perplexity over sentences, by an expression of doc_id."""
    return sub(
        rf"""{tables},
st AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, list_filter({texts.SENT}, lambda x: length(x) > 3) AS l FROM en)),
t AS (SELECT doc_id, k, lower(t) AS token, pos FROM (SELECT doc_id, k, unnest(l) AS t, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, k, regexp_extract_all(s, '[\p{{L}}\p{{N}}_]+') AS l FROM st))),
q AS (SELECT *, coalesce(lag(token) OVER (PARTITION BY doc_id, k ORDER BY pos), '') AS prev FROM t),
z AS (SELECT doc_id, k, -avg({log_p}) AS x FROM q {model} GROUP BY doc_id, k HAVING count(*) >= 2),
y AS (SELECT {group} AS id, count(*) AS c, stddev_pop(x) AS s, avg(x) AS m FROM z GROUP BY 1)""",
        "SELECT id, CASE WHEN c >= 2 THEN round(CASE WHEN s + m = 0 THEN 0 ELSE (s - m) / (s + m) END, 5) END AS burst FROM y",
    )


#: Words between white space.
_WORDS = rf"len(list_filter(string_split_regex({texts.STRIP}, '\s+'), lambda x: x <> ''))"
_TOKENS = r"list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x))"


def vectors_sql(name: str, rows: str, key: str, text: str = "text") -> str:
    """Tables {name}_v (key, place, v) and {name}_n (key, norm) of the hashed vectors of the texts of a table expression."""
    return rf"""{name}_t AS (SELECT {key}, unnest({_TOKENS.format(text)}) AS token FROM {rows}),
{name}_v AS (SELECT {key}, substr(to_base64(unhex(md5(token))), 1, 1) AS place, sum(CASE WHEN right(md5(token), 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS v FROM {name}_t GROUP BY ALL),
{name}_n AS (SELECT {key}, sqrt(sum(v * v)) AS norm FROM {name}_v GROUP BY {key} HAVING sum(v * v) > 0)"""


def templates_sql(rows: str, key: str, above: float) -> str:
    """Largest cosine to an item of the benchmark and the share of items above a threshold, by key."""
    return sub(
        f"""{vectors_sql('a', rows, key)}, {vectors_sql('b', 'benchmark', 'item_id')},
c AS (SELECT {key}, item_id, sum(a_v.v * b_v.v) / any_value(a_n.norm * b_n.norm) AS c FROM a_v JOIN b_v USING (place) JOIN a_n USING ({key}) JOIN b_n USING (item_id) GROUP BY {key}, item_id),
k AS (SELECT {key}, max(c) AS c, count(*) AS n, count(*) FILTER (WHERE c > {above}) AS above FROM c GROUP BY {key}), m AS (SELECT count(*) AS items FROM benchmark)""",
        f"SELECT {key}, CASE WHEN n IS NULL THEN 0 WHEN n < items THEN greatest(0, c) ELSE c END AS largest, coalesce(above, 0) / items AS share FROM (SELECT DISTINCT {key} FROM {rows}) r LEFT JOIN k USING ({key}), m",
    )


def neutral_sql(text: str) -> str:
    """T.neutral.  Letters beyond ASCII stand between underscores meanwhile, so that ASCII word boundaries are right."""
    out = rf"regexp_replace({text}, '([^\P{{L}}\x00-\x7F]|[^\P{{N}}\x00-\x7F])', '_\1_', 'g')"
    for p in T.NEUTRALIZED:
        out = f"regexp_replace({out}, '(?i){texts._Q(p)}', '', 'g')"
    runs = rf"string_split(regexp_replace({out}, '(\b[A-Z]{{3,}}\b)', chr(1) || '\1' || chr(1), 'g'), chr(1))"
    out = f"array_to_string(list_transform({runs}, lambda x, i: CASE WHEN i % 2 = 0 THEN lower(x) ELSE x END), '')"
    out = rf"regexp_replace(regexp_replace({out}, '{texts._Q(T.HYPERBOLE)}', '', 'g'), '(?i)\b({'|'.join(sorted(STRONG))})\b', '', 'g')"
    out = rf"regexp_replace({out}, '_([^\x00-\x7F])_', '\1', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace({out}, '([!?]){{2,}}', '\1', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


NEUTRAL_GAP = sub(
    rf"""x AS (SELECT doc_id, text, {neutral_sql('text')} AS neutral FROM documents WHERE regexp_matches(text, '\S')), {vectors_sql('a', 'x', 'doc_id')}, {vectors_sql('b', 'x', 'doc_id', 'neutral')},
c AS (SELECT doc_id, sum(a_v.v * b_v.v) / any_value(a_n.norm * b_n.norm) AS c FROM a_v JOIN b_v USING (doc_id, place) JOIN a_n USING (doc_id) JOIN b_n USING (doc_id) GROUP BY doc_id),
r AS (SELECT *, least(1.0, length(neutral) / greatest(1, length(text))) AS ratio FROM x)""",
    "SELECT doc_id, ratio AS length_ratio, (1 - ratio) * (1 - CASE WHEN neutral IN ('', '-') THEN 0 ELSE greatest(0, coalesce(c, 0)) END) AS gap FROM r LEFT JOIN c USING (doc_id)",
)
ORACLE["q_neutralize"] = f"SELECT doc_id, round(length_ratio, 6) AS length_ratio, round(gap, 6) AS neutralization_gap FROM {NEUTRAL_GAP}"
_O = {k: f"({v})" for k, v in ORACLE.items()}

#: Columns of the comment row, each with its SQL over the parts joined below.
_COMMENT = {
    "psi_1": "CASE WHEN p.n_tokens >= 2 THEN psi_1 END", "psi_2": "burst", "psi_3": "CASE WHEN w.words >= 5 THEN round(curvature, 4) END", "psi_4": "top10_share", "psi_5": "top100_share",
    "psi_6": r"CASE WHEN regexp_matches(d.text, '\S') THEN fingerprint END", "psi_7": "regularity", "psi_8": r"CASE WHEN regexp_matches(d.text, '\S') THEN hedging END",
    "chi_1": "arousal_intensity", "chi_2": "negative_share", "chi_3": "prefix_share", "chi_4": "association", "chi_5": "rhetoric", "chi_6": "affect_ratio", "chi_7": "round(gap, 6)", "chi_8": "round(ma - 0.5, 6)",
    "chi_9": r"CASE WHEN regexp_matches(d.text, '\S') THEN round(largest, 6) END", "chi_10": r"CASE WHEN regexp_matches(d.text, '\S') THEN round(share, 6) END",
}
_COMMENT_PARTS = [
    f"{_O['q_nearest_bucket']} n USING (doc_id)", f"{_O['q_bigram_perplexity']} p USING (doc_id)", f"{sentences_sql(texts._BI, 'doc_id')} b ON b.id = d.doc_id",
    f"{sub(texts.curvature_sql(texts._BI, 20), 'SELECT * FROM cu')} c USING (doc_id)", f"(SELECT doc_id, {_WORDS} AS words FROM documents) w USING (doc_id)",
    *[f"{_O[q]} {q[2:]} USING (doc_id)" for q in ("q_rank_share", "q_ai_phrases", "q_punct_regularity", "q_hedges", "q_affect", "q_vice_prefix", "q_outgroup_window", "q_rhetoric", "q_info_affect")],
    f"{NEUTRAL_GAP} g USING (doc_id)", f"{sub(f'{texts.TOK}, {texts.LEX}, {texts.AFF}', 'SELECT doc_id, ma FROM aff')} f USING (doc_id)", f"{templates_sql('documents', 'doc_id', 0.5)} t USING (doc_id)",
]


def comment_sql(columns: dict[str, str], parts: list[str] = _COMMENT_PARTS) -> str:
    return "SELECT d.doc_id, " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + " FROM documents d" + "".join(f"\nLEFT JOIN {p}" for p in parts)


_DIGITS = {"psi_1": 5, "psi_2": 5, "psi_3": 4}


@query(comment_sql(_COMMENT))
def q_comment_row(spark, sf_dir):
    """All 18 columns; without a topic model, arousal is taken relative to 0.5."""
    return rounded(features.comment_features(texts.documents(spark, sf_dir), lexicons(spark, sf_dir)), _DIGITS)


def _brittle():
    """A feature that fails on every text with a multiple of seven words."""
    return lambda rows: [(1 / (len((text or "").split()) % 7),) for (text,) in rows]


@query(comment_sql(_COMMENT | {"psi_8": f"(SELECT CASE WHEN n % 7 > 0 THEN round(1 / (n % 7), 6) END FROM (SELECT len(regexp_extract_all(d.text, '[^\\s\\x0B\\x1C-\\x1F\\x85\\p{{Z}}]+')) AS n))"}))
def q_fault_isolation(spark, sf_dir):
    """The same with a caller's extractor for hedges that fails on some rows: psi_8 is null there, all else stays."""
    brittle = features.python_feature(backends.Fence(_brittle, [("psi_8", "double")], name="brittle"))
    return rounded(features.comment_features(texts.documents(spark, sf_dir), lexicons(spark, sf_dir), instead={"hedges": brittle}), _DIGITS)


_HALF = texts._BI.replace("bi AS (SELECT prev, token, count(*) AS n FROM p GROUP BY ALL)", "bi AS (SELECT prev, token, count(*) AS n FROM p WHERE doc_id % 2 = 0 GROUP BY ALL)").replace(
    "ln((n + 0.1) / (np + 0.1 * 5000)) AS lp, rk FROM p JOIN bp", "ln((coalesce(n, 0) + 0.1) / (coalesce(np, 0) + 0.1 * 5000)) AS lp, rk FROM p LEFT JOIN bp"
)
_HALF_LENGTHS = "lb AS (SELECT ((n_tokens // 10) * 10 + 5)::INT AS center, avg(ln(pp)) AS mu, stddev_pop(ln(pp)) + 1e-6 AS sigma FROM pp WHERE n_tokens >= 4 AND pp > 1 AND doc_id % 2 = 0 GROUP BY 1 HAVING count(*) >= 5)"
_HALF_PERPLEXITY = sub(
    f"{_HALF}, {_HALF_LENGTHS}, m AS (SELECT doc_id, pp, mu, sigma, row_number() OVER (PARTITION BY doc_id ORDER BY abs(center - n_tokens), center) AS r FROM pp, lb WHERE n_tokens >= 2)",
    "SELECT doc_id, round((ln(CASE WHEN pp > 1 THEN pp END) - mu) / sigma, 5) AS psi_1 FROM m WHERE r = 1",
)
_HALF_RANKS = sub(_HALF, "SELECT doc_id, round(count(*) FILTER (WHERE pos > 0 AND rk <= 10) / (count(*) - 1), 6) AS psi_4, round(count(*) FILTER (WHERE pos > 0 AND rk <= 100) / (count(*) - 1), 6) AS psi_5 FROM sc GROUP BY doc_id HAVING count(*) > 1")
_HALF_PUNCTUATION = sub(
    f"{texts._LONG}, b AS (SELECT pattern, avg(rate) AS mu, stddev_pop(rate) + 1e-6 AS sigma FROM r WHERE doc_id % 2 = 0 GROUP BY pattern)", "SELECT doc_id, round(avg(abs(rate - mu) / sigma), 6) AS psi_7 FROM r JOIN b USING (pattern) GROUP BY doc_id"
)


@query(f"SELECT d.doc_id, psi_1, psi_4, psi_5, psi_7 FROM documents d LEFT JOIN {_HALF_PERPLEXITY} p USING (doc_id) LEFT JOIN {_HALF_RANKS} r USING (doc_id) LEFT JOIN {_HALF_PUNCTUATION} u USING (doc_id)")
def q_trained_baselines(spark, sf_dir):
    """Language model and baselines fitted on the even half of the documents, scores for all of them."""
    docs = texts.documents(spark, sf_dir)
    lex = features.fit_baselines(docs.where("doc_id % 2 = 0"), lexicons(spark, sf_dir))
    skip = {name for name, *_ in features.COMMENT_FEATURES} - {"perplexity", "ranks", "punctuation"}
    return rounded(features.comment_features(docs, lex, skip=skip), _DIGITS)


#: Words that the second back end knows.
_KNOWN = 2000
_UNI = f"""{texts.TOK}, u AS (SELECT token, count(*) AS n FROM tok GROUP BY token), tt AS (SELECT sum(n) AS t FROM u),
top AS (SELECT token, n, rank() OVER (ORDER BY n DESC) AS rk FROM (SELECT * FROM u ORDER BY n DESC, token LIMIT {_KNOWN})),
sc AS (SELECT doc_id, pos, tok.token, ln((coalesce(n, 0) + 0.1) / (t + 500.0)) AS lp, rk FROM tok LEFT JOIN top USING (token), tt),
pp AS (SELECT doc_id, count(*) AS n_tokens, exp(-avg(lp)) AS pp FROM sc GROUP BY doc_id),
lb AS (SELECT ((n_tokens // 10) * 10 + 5)::INT AS center, avg(ln(pp)) AS mu, stddev_pop(ln(pp)) + 1e-6 AS sigma FROM pp WHERE n_tokens >= 4 AND pp > 1 GROUP BY 1 HAVING count(*) >= 5)"""
_UNI_PARTS = {
    "psi_1": sub(
        f"{_UNI}, m AS (SELECT doc_id, pp, mu, sigma, row_number() OVER (PARTITION BY doc_id ORDER BY abs(center - n_tokens), center) AS r FROM pp, lb WHERE n_tokens >= 2)",
        "SELECT doc_id, round((ln(CASE WHEN pp > 1 THEN pp END) - mu) / sigma, 5) AS psi_1 FROM m WHERE r = 1",
    ),
    "psi_2": f"(SELECT id AS doc_id, burst AS psi_2 FROM {sentences_sql(_UNI, 'doc_id', 'ln((coalesce(top.n, 0) + 0.1) / (t + 500.0))', 'LEFT JOIN top USING (token) CROSS JOIN tt')})",
    "psi_3": sub(
        f"""{_UNI}, b AS (SELECT ln((max(n) + 0.1) / (any_value(t) + 500.0)) AS best FROM top, tt),
co AS (SELECT doc_id, c AS copy, round(sum(CASE WHEN c > 0 AND substr(sha256(doc_id || ':' || pos), 2 * c - 1, 2) < '{L.REPLACED_BELOW}' THEN best ELSE lp END), 9) AS lp FROM sc, b, range(21) r(c) GROUP BY doc_id, c),
w AS (SELECT doc_id, {_WORDS} AS words FROM documents)""",
        """SELECT doc_id, round((max(lp) FILTER (WHERE copy = 0) - avg(lp) FILTER (WHERE copy > 0)) / CASE WHEN stddev_samp(lp) FILTER (WHERE copy > 0) > 0 THEN stddev_samp(lp) FILTER (WHERE copy > 0) ELSE 1e-8 END, 4) AS psi_3
FROM co JOIN w USING (doc_id) WHERE words >= 5 GROUP BY doc_id""",
    ),
    "psi_4": sub(_UNI, "SELECT doc_id, round(count(*) FILTER (WHERE pos > 0 AND rk <= 10) / (count(*) - 1), 6) AS psi_4, round(count(*) FILTER (WHERE pos > 0 AND rk <= 100) / (count(*) - 1), 6) AS psi_5 FROM sc GROUP BY doc_id HAVING count(*) > 1"),
}


@query("SELECT d.doc_id, psi_1, psi_2, psi_3, psi_4, psi_5 FROM documents d" + "".join(f"\nLEFT JOIN {v} {k}_t USING (doc_id)" for k, v in _UNI_PARTS.items()))
def q_second_back_end(spark, sf_dir):
    """The likelihood features by a model in Python behind Arrow batches instead of the bigram model."""
    docs, lex = texts.documents(spark, sf_dir), lexicons(spark, sf_dir)
    model = backends.WordFrequencies.fitted(comments.token_table(docs), _KNOWN)
    lex.likelihood = backends.ArrowLikelihood(lambda: model)
    skip = {name for name, *_ in features.COMMENT_FEATURES} - {"perplexity", "burstiness", "curvature", "ranks"}
    return rounded(features.comment_features(docs, lex, skip=skip), _DIGITS)


_OWN = "en AS (SELECT conv_id AS doc_id, text, regexp_replace(text, '$^', '') AS u FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1))"
_MESSAGES = "en AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations WHERE role = 'assistant')"
_BIM = texts._BI.replace(texts.EN, _MESSAGES)
_OWN_O = {k: f"({ORACLE[k].replace(texts.EN, _OWN)})" for k in ("q_mattr", "q_yule_k", "q_zipf")}
_OF_MESSAGE = "doc_id // 1000"
_MESSAGE_NAME = "(doc_id // 1000) || ':' || (doc_id % 1000)"
_SAID = f"o AS (SELECT conv_id, turn, text, {_TOKENS.format('text')} AS t FROM conversations WHERE role = 'assistant')"
_MOOD = rf"""{_SAID}, v AS (SELECT conv_id, turn, sign(len(list_filter(t, lambda x: x IN ({sql_list(C.POSITIVE)}))) - len(list_filter(t, lambda x: x IN ({sql_list(C.NEGATIVE)}))))::DOUBLE AS s,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM o)"""
_HALVES = rf"""o AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 >= count(*) OVER (PARTITION BY conv_id) // 2 AS late, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'assistant'),
h AS (SELECT conv_id, late, unnest({_TOKENS.format('text')}) AS token FROM o WHERE n >= 4), c AS (SELECT conv_id, token, count(*) FILTER (WHERE late) AS l, count(*) FILTER (WHERE NOT late) AS e FROM h GROUP BY ALL),
t AS (SELECT *, sum(l) OVER (PARTITION BY conv_id) AS nl, sum(e) OVER (PARTITION BY conv_id) AS ne, count(*) OVER (PARTITION BY conv_id) AS v FROM c)"""
_BOTH = "first(nl) > 0 AND first(ne) > 0"
_CONVERSATION_PARTS = {
    "phi_1": sub(_BIM, f"SELECT {_OF_MESSAGE} AS conv_id, round(avg(pp), 4) AS phi_1 FROM pp WHERE n_tokens >= 2 GROUP BY 1"),
    "phi_2": f"(SELECT id AS conv_id, burst AS phi_2 FROM {sentences_sql(_BIM, _OF_MESSAGE)})",
    "phi_3": sub(
        f"{texts.curvature_sql(_BIM, 10, _MESSAGE_NAME)}, w AS (SELECT conv_id * 1000 + turn AS doc_id, {_WORDS} AS words FROM conversations)",
        f"SELECT {_OF_MESSAGE} AS conv_id, round(avg(curvature), 4) AS phi_3 FROM cu JOIN w USING (doc_id) WHERE words >= 20 GROUP BY 1",
    ),
    "phi_4, phi_5": sub(
        _BIM,
        f"SELECT {_OF_MESSAGE} AS conv_id, round(count(*) FILTER (WHERE pos > 0 AND rk <= 10) / nullif(count(*) FILTER (WHERE pos > 0), 0), 6) AS phi_4, round(count(*) FILTER (WHERE pos > 0 AND rk <= 100) / nullif(count(*) FILTER (WHERE pos > 0), 0), 6) AS phi_5 FROM sc GROUP BY 1",
    ),
    "phi_6": f"(SELECT doc_id AS conv_id, mattr AS phi_6 FROM {_OWN_O['q_mattr']})",
    "phi_7": f"(SELECT doc_id AS conv_id, yule_k AS phi_7 FROM {_OWN_O['q_yule_k']})",
    "phi_8": f"(SELECT doc_id AS conv_id, zipf_deviation AS phi_8 FROM {_OWN_O['q_zipf']})",
    "phi_9": f"(SELECT conv_id, length_asymmetry AS phi_9 FROM {_O['q_length_asym']})",
    "phi_10": sub(
        """g AS (SELECT conv_id, 60.0 * (turn * turn - lag(turn * turn) OVER (PARTITION BY conv_id ORDER BY turn)) AS gap FROM conversations WHERE role = 'assistant'),
s AS (SELECT conv_id, count(gap)::DOUBLE AS n, skewness(gap) AS g1, kurtosis(gap) AS g2 FROM g WHERE gap > 0 GROUP BY conv_id)""",
        "SELECT conv_id, CASE WHEN n >= 4 THEN round((g1 * g1 + 1) / (g2 + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))), 6) END AS phi_10 FROM s",
    ),
    "phi_11": sub(
        f"""{_MOOD}, b AS (SELECT conv_id, median(s) AS mu FROM v WHERE i <= greatest(2, n // 2) GROUP BY conv_id),
r AS (SELECT conv_id, turn, n, sum(mu - s - 0.25) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM v JOIN b USING (conv_id)),
k AS (SELECT conv_id, n, run - least(0, min(run) OVER (PARTITION BY conv_id ORDER BY turn)) AS g FROM r)""",
        "SELECT conv_id, CASE WHEN first(n) >= 4 THEN round(max(g), 6) END AS phi_11 FROM k GROUP BY conv_id",
    ),
    "phi_12": sub(_MOOD, "SELECT conv_id, CASE WHEN count(*) >= 4 THEN round(regr_slope(s, i - 1), 6) END AS phi_12 FROM v GROUP BY conv_id"),
    "phi_13, phi_14": sub(
        _HALVES,
        f"""SELECT conv_id, CASE WHEN {_BOTH} THEN round(sum((l + 0.5) / (nl + 0.5 * v) * ln(((l + 0.5) / (nl + 0.5 * v)) / ((e + 0.5) / (ne + 0.5 * v)))), 6) END AS phi_13,
CASE WHEN {_BOTH} THEN round(sum(CASE WHEN token IN ({sql_list(FINANCE)}) THEN l ELSE 0 END) / first(nl), 6) END AS phi_14 FROM t GROUP BY conv_id""",
    ),
    "phi_17, phi_18, phi_19": f"""(SELECT part // 1000 AS conv_id, round(max(largest), 6) AS phi_17, round(avg(largest), 6) AS phi_18, round(avg((largest > 0.75)::INT), 6) AS phi_19
FROM {templates_sql("(SELECT conv_id * 1000 + turn AS part, text FROM conversations WHERE role = 'assistant')", 'part', 0.75)} GROUP BY 1)""",
}


@query(f"SELECT d.conv_id, {', '.join(_CONVERSATION_PARTS)} FROM (SELECT DISTINCT conv_id FROM conversations) d" + "".join(f"\nLEFT JOIN {v} t{k} USING (conv_id)" for k, v in enumerate(_CONVERSATION_PARTS.values())))
def q_conversation_row(spark, sf_dir):
    """All columns but those of the stage models, which are fitted by iterations."""
    return rounded(features.conversation_features(timed_messages(spark, sf_dir), lexicons(spark, sf_dir), skip=("stages",)), {"phi_1": 4, "phi_2": 5, "phi_3": 4})


AI_FEATURES, RB_FEATURES = [f"psi_{k}" for k in range(1, 9)], [f"chi_{k}" for k in range(1, 11)]


@query()
def q_scored_comments(spark, sf_dir):
    """From texts to answers: all 18 features with a topic model, two heads fitted on the labels (five folds, ten penalties), joint score, verdict, red flags and the JSON response."""
    docs, lex = texts.documents(spark, sf_dir), lexicons(spark, sf_dir)
    lex.topic_model = features.fitted_topics
    rows = materialize(features.comment_features(docs, lex), "scored-features")
    known = materialize(rows.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("ai"), F.col("toxic").alias("rb")), "doc_id"), "scored-labels")
    scored = models.joint(rows, models.fit_head(known, AI_FEATURES, "ai", "doc_id"), models.fit_head(known, RB_FEATURES, "rb", "doc_id"))
    answer = scored.select(
        "doc_id", D.verdict(F.col("p_ai"), F.col("p_ragebait")).alias("verdict"), D.light(F.col("p_ai")).alias("light_ai"), D.light(F.col("p_ragebait")).alias("light_ragebait"),
        *[F.round(c, 4).alias(c) for c in ("p_ai", "p_ragebait", "p_joint")], D.red_flags(D.COMMENT_FLAGS, rows.columns).alias("flags"),
    )
    return answer.select("doc_id", "verdict", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("response"))
