"""The operators of this subpackage bound to the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import chat, decontaminate, filter_audit, html_text, merkle, mixing, near_dup, pii, quality, secrets, sharding, substring, suffix_dedup
from quillstone.llm.common import table


def op1_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents")).drop("removed")


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_near_dup_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(table(spark, sf_dir, "documents"), size=4).drop("text_hash", "stays")


def op5_decontaminate_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_mixing_ipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weights(table(spark, sf_dir, "documents"))


def op8_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    back = chat.read_back(chat.format_texts(rows.unionByName(extra)))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "n_tokens",
        F.size("attachments").cast("long").alias("n_attachments"),
    )


def op9_html_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_sharding_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, columns = table(spark, sf_dir, "documents"), ("doc_id", "source", "lang", "n_chars", "text")
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    changed = merkle.digest_of([lower if c == "text" else F.col(c) for c in columns])
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, changed)
    out = merkle.manifest(docs, columns, "lang", "doc_id", altered)
    out = out.withColumn("folded_root", merkle.folded(F.coalesce("altered", "leaf")))
    return out.select(
        "doc_id", "leaf", "subroot", "root", merkle.siblings_digest().alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_substring_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents")).drop("removed")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_pii_skip_chain, op2_suffix_dedup, op3_secret_ownership, op4_near_dup_bayes, op5_decontaminate_spaced_seeds, op6_quality_rules, op7_mixing_ipf, op8_chat_parts, op9_html_tree_scoring, op10_sharding_ring, op11_merkle_manifest, op12_substring_rlz, op13_filter_audit)}

_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
_SQL_ATTACHMENT = chat.ATTACHMENT.replace("'", "''")
_SQL_KIND = "CASE " + " ".join(rf"WHEN regexp_matches(f, '^data:(?:{chat.MEDIA[k]})/|\.(?:{e})\)?$') THEN '{k}'" for k, e in chat.ENDINGS.items()) + " WHEN starts_with(f, '![') THEN 'image' ELSE 'document' END"
_SQL_TOKENS = " ".join(f"WHEN '{k}' THEN {n}" for k, (_, n) in chat.PLACEHOLDERS.items())
_SECRET_PATTERNS = [(k.pattern.replace("'", "''"), 1 + k.value_group, k.name, k.least) for k in (*secrets.BASE, secrets.BARE)]
_SECRET_MATCHES = " UNION ALL ".join(
    f"SELECT rid, {n} AS ord, '{name}' AS kind, {least} AS least, unnest(regexp_extract_all(t, '({p})', 1)) AS found, unnest(regexp_extract_all(t, '({p})', {g})) AS value, "
    f"unnest(list_transform(string_split_regex(t, '{p}')[:-2], lambda x: length(x))) AS gap, unnest(range(len(regexp_extract_all(t, '{p}')))) AS i FROM d WHERE regexp_matches(t, '{p}')"
    for n, (p, g, name, least) in enumerate(_SECRET_PATTERNS)
)
#: The base patterns of personal data, and what a match must fulfil.
_DIGITS = "regexp_replace(found, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, k: CASE WHEN k % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0"
_PRIVATE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"), ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(found, '.'), lambda x: length(ltrim(x, '0')) > 3 OR try_cast(x AS HUGEINT) > 255)) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
)
_PRIVATE_MATCHES = " UNION ALL ".join(
    f"SELECT rid, {n} AS ord, '{name}' AS kind, unnest(regexp_extract_all(t, '{p}')) AS found, unnest(list_transform(string_split_regex(t, '{p}')[:-2], lambda x: length(x))) AS gap, unnest(range(len(regexp_extract_all(t, '{p}')))) AS i FROM d WHERE regexp_matches(t, '{p}')"
    for n, (name, p, _) in enumerate(_PRIVATE)
)
_PRIVATE_OK = "CASE ord " + " ".join(f"WHEN {n} THEN {ok}" for n, (_, _, ok) in enumerate(_PRIVATE)) + " END"


def _merkle_sql(levels: int = 8, upper: int = 3) -> str:
    """The trees of up to 8 ** levels rows of a language and 8 ** upper languages."""
    told = lambda text: " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    crc = "xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"
    out = [
        f"WITH d AS (SELECT doc_id, lang, sha256({told('text')}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({told(lower)}) END AS altered FROM documents)",
        "a0 AS (SELECT *, coalesce(altered, leaf) AS fold, '' AS proof, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d)",
        "na0 AS (SELECT tree, place, leaf AS h, count(*) OVER (PARTITION BY tree) AS c FROM a0)",
    ]
    for x, n in (("a", levels), ("b", upper)):
        if x == "b":
            out += [
                f"s AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM na{levels})",
                "nb0 AS (SELECT '' AS tree, place, subroot AS h, count(*) OVER () AS c FROM s)",
                f"b0 AS (SELECT a.doc_id, a.leaf, a.fold, a.proof, s.subroot, '' AS tree, s.place FROM a{levels} a JOIN s USING (tree))",
            ]
        for k in range(n):
            side = lambda rows: f"coalesce(string_agg(h, '') OVER (PARTITION BY tree, place // 8 ORDER BY place ROWS BETWEEN {rows}), '')"
            out += [
                f"r{x}{k} AS (SELECT tree, place, c, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM n{x}{k})",
                f"{x}{k + 1} AS (SELECT f.* REPLACE (CASE WHEN c = 1 THEN fold ELSE sha256(l || fold || r) END AS fold, CASE WHEN c = 1 THEN proof ELSE proof || l || r END AS proof, f.place // 8 AS place) FROM {x}{k} f JOIN r{x}{k} r ON r.tree = f.tree AND r.place = f.place)",
                f"n{x}{k + 1} AS (SELECT tree, place // 8 AS place, CASE WHEN any_value(c) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY place)) END AS h, (any_value(c) + 7) // 8 AS c FROM n{x}{k} GROUP BY tree, place // 8)",
            ]
    last = f"SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM b{upper} JOIN nb{upper} USING (tree)"
    return ",\n".join(out) + "\n" + last


ORACLE = {
    # the given tables hold nothing that the field adds to the base spans
    "op1_pii_skip_chain": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), m AS ({_PRIVATE_MATCHES}),
p AS (SELECT *, sum(gap + length(found)) OVER (PARTITION BY rid, ord ORDER BY i) AS e FROM m), q AS (SELECT rid, ord, kind, e - length(found) AS s, e FROM p WHERE {_PRIVATE_OK}),
b AS (SELECT rid, count(*) AS n, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans, {", ".join(f"count(*) FILTER (WHERE ord = {n}) AS n_{name}" for n, (name, _, _) in enumerate(_PRIVATE))} FROM q GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name, _, _ in _PRIVATE)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n, 0) AS n_spans FROM d LEFT JOIN b USING (rid)""",
    "op2_suffix_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT rid, i, hash(b[i + 1:i + 400]) AS h FROM (SELECT rid, b, unnest(range(n - 399)) AS i FROM d WHERE n >= 400)),
c AS (SELECT rid, i AS lo, i + 400 AS hi FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
k AS (SELECT rid, lo, hi, coalesce(lo > max(hi) OVER (PARTITION BY rid ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM c),
r AS (SELECT rid, g, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY lo) AS g FROM k) GROUP BY rid, g),
s AS (SELECT rid, lo, hi, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY lo), 0) AS before FROM r),
a AS (SELECT rid, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(hex(b[before + 1:lo]), '' ORDER BY lo) AS head, max(hi) AS last FROM s JOIN d USING (rid) GROUP BY rid),
p AS (SELECT rid, k, strlen(word) AS len, sum(strlen(gap) + strlen(word)) OVER (PARTITION BY rid ORDER BY k) AS e FROM (SELECT rid, unnest(x) AS word, unnest(y[:-2]) AS gap, generate_subscripts(x, 1) AS k FROM
      (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS x, string_split_regex(t, '[^\x20\x09-\x0D]+') AS y FROM d))),
q AS (SELECT rid, e - len AS lo, lead(e, 49) OVER (PARTITION BY rid ORDER BY k) AS hi FROM p),
v AS (SELECT rid, lo, hi, hash(b[lo + 1:hi]) AS h FROM q JOIN d USING (rid) WHERE hi IS NOT NULL),
f AS (SELECT rid, lo, hi, max(hi) OVER (PARTITION BY rid ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v WHERE h IN (SELECT h FROM v GROUP BY h HAVING count(*) > 1)),
z AS (SELECT rid, sum(hi - greatest(lo, coalesce(reach, 0))) AS n_passage_bytes FROM f GROUP BY rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN head IS NULL THEN b ELSE unhex(head || hex(b[last + 1:n])) END) AS kept_sha256, coalesce(n_passage_bytes, 0)::BIGINT AS n_passage_bytes
FROM d LEFT JOIN a USING (rid) LEFT JOIN z USING (rid)""",
    "op3_secret_ownership": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner FROM documents),
m AS ({_SECRET_MATCHES}),
p AS (SELECT *, sum(gap + length(found)) OVER (PARTITION BY rid, ord ORDER BY i) AS e FROM m),
q AS (SELECT rid, ord, kind, value, e - length(found) AS s, e FROM p WHERE length(value) >= least),
v AS (SELECT DISTINCT rid, value, e - length(value) AS s, e, regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= {secrets.LEAST_DISTINCT}
        AND len(list_filter(range(1, length(value) - 2), lambda k: value[k] = value[k + 1] AND value[k] = value[k + 2] AND value[k] = value[k + 3])) = 0
        AND NOT regexp_matches(lower(value), 'example|sample|dummy|changeme|placeholder|your') AS live FROM q),
o AS (SELECT value, count(*) AS repos, count(DISTINCT owner) AS owners FROM (SELECT value, t, min(owner) AS owner FROM v JOIN d USING (rid) GROUP BY value, t) GROUP BY value),
j AS (SELECT v.*, repos, owners > {secrets.MOST_OWNERS} OR repos > {secrets.MOST_REPOSITORIES} AS example FROM v JOIN o USING (value)),
b AS (SELECT rid, count(*) FILTER (WHERE ord = 0) AS n0, count(*) FILTER (WHERE ord = 1) AS n1, count(*) FILTER (WHERE ord = 2) AS n2, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS base FROM q WHERE ord < 3 GROUP BY rid),
w AS (SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans FROM (SELECT rid, ord, kind, s, e FROM q WHERE ord < 3 UNION ALL SELECT DISTINCT rid, 3, 'owned', s, e FROM j WHERE live AND NOT example) GROUP BY rid),
a AS (SELECT rid, count(*) FILTER (WHERE live AND NOT example) AS n_owned, count(*) FILTER (WHERE example) AS n_copied, max(repos) AS most FROM j GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied, coalesce(most, 0)::BIGINT AS most_repositories
FROM d LEFT JOIN b USING (rid) LEFT JOIN w USING (rid) LEFT JOIN a USING (rid)""",
    "op4_near_dup_bayes": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, u.y FROM r JOIN u ON u.x = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op5_decontaminate_spaced_seeds": r"""
WITH d AS (SELECT DISTINCT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d), iw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS q FROM i),
g AS (SELECT doc_id, item_id, p - q AS shift, any_value(n) AS n, least(20, any_value(n)) AS size, list(q) AS qs, count(*) AS total FROM dw JOIN iw USING (word) GROUP BY 1, 2, 3 HAVING 100 * count(*) >= 80 * least(20, any_value(n))),
s AS (SELECT *, list_max(list_transform(range(0, n - size + 1), lambda k: len(list_filter(qs, lambda q: q >= k AND q < k + size)))) AS best FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY total DESC, best DESC, shift) AS rn FROM s WHERE 100 * best >= 80 * size)
SELECT doc_id, item_id, best::BIGINT AS n_matched, size::BIGINT AS n_compared, total AS n_matched_item, shift::BIGINT AS first_word FROM r WHERE rn = 1""",
    "op6_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
g AS (SELECT rid, pos, word, concat_ws(chr(31), word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS win,
             lead(word, 4) OVER o IS NOT NULL AS whole FROM p WINDOW o AS (PARTITION BY rid ORDER BY pos)),
r AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, win) AS c FROM g WHERE whole) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT pos + k) AS n FROM r, range(5) AS s(k) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(dup.n_lines, 0) AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: lower(x) IN ({_STOP}))) AS n_stop,
             len(list_filter(ws, lambda x: regexp_full_match(x, '[A-Z]{{2,}}[^a-z]*'))) AS n_upper
      FROM w LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2.0 * n_words AND 14.0 * n_words AND n_symbols <= 0.25 * n_words
       AND (n_words < 50 OR n_stop >= 0.01 * n_words) AND (n_words < 50 OR n_dup_lines <= 0.5 * n_lines)
       AND (n_words < 20 OR n_upper <= 0.6 * n_words) AS kept
FROM f""",
    "op8_chat_parts": rf"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
           SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)),
e AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
p AS (SELECT *, regexp_extract_all(text, '{_SQL_ATTACHMENT}') AS found, string_split_regex(text, '{_SQL_ATTACHMENT}') AS gaps FROM e),
x AS (SELECT *, list_transform(gaps, lambda g: replace(replace(replace(replace(replace(replace(g, '~', '~0'), '<|', '~1'), '</s>', '~2'), '<s>', '~3'), '[INST]', '~4'), '[/INST]', '~5')) AS bodies,
             list_transform(found, lambda f: {_SQL_KIND}) AS kinds FROM p)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + list_sum(list_transform(bodies, lambda g: length(g))) + coalesce(list_sum(list_transform(kinds, lambda k: length(k) + 4)), 0) + 16)::BIGINT AS formatted_chars,
       sum(list_sum(list_transform(gaps, lambda g: len(regexp_extract_all(g, '[^\x20\x09-\x0D]+')))) + coalesce(list_sum(list_transform(kinds, lambda k: CASE k {_SQL_TOKENS} END)), 0))::BIGINT AS n_tokens,
       sum(len(found))::BIGINT AS n_attachments
FROM x GROUP BY conv_id""",
    # the given pages hold an article each, of paragraphs, headings, line breaks and two references; the operator knows nothing of that
    "op9_html_tree_scoring": r"""
WITH a AS (SELECT page_id, url, string_split_regex(replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<br>', ' '), '</?(?:p|h1)[^>]*>') AS parts FROM pages),
b AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c""",
    "op11_merkle_manifest": _merkle_sql(),
    "op12_substring_rlz": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rid, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
v AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
f AS (SELECT rid, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again FROM v),
k AS (SELECT rid, i, word, coalesce(max(again::INT) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS gone FROM p LEFT JOIN f USING (rid, i)),
r AS (SELECT rid, i, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY rid ORDER BY i), false) AS begins, word FROM k),
a AS (SELECT rid, count(*) AS n, count(*) FILTER (WHERE gone) AS removed, count(*) FILTER (WHERE begins) AS n_spans, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM r GROUP BY rid)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (rid)""",
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
v AS (SELECT part, (CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END)
        || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
        || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN m USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM v GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, k::INT AS step, substr(filter_order, k, 1) AS filter, substr(filter_order, 1, k - 1) AS before FROM o, range(1, 6) r(k)),
j AS (SELECT *, contains(fails, filter) AS hit, translate(fails, before, '') = fails AS alive FROM c, s),
r AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (WHERE alive AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (WHERE alive AND hit), 0) AS removed,
        coalesce(sum(n) FILTER (WHERE hit AND NOT alive), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails = filter), 0) AS unique_fails,
        coalesce(sum(good) FILTER (WHERE alive AND hit), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE alive AND hit), 0) AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r""",
}
