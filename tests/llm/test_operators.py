"""The training-data operators against brute-force versions, and on edge cases."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from quillstone.llm import chat, decontaminate, html_text, mixing, near_dup, pii, quality, queries, secrets, sharding, suffix_dedup

from tests.compare import DATA, rows_of, rows_of_sql
from tests.llm import plain

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 977}" for i in range(30000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (None, "null id text with some words in it for good measure", "xx", "b", 3),
        (3, long, "de", "a", 1), (4, long + " end", "de", "a", 1), (5, "same row", "en", "c", 8), (5, "same row", "en", "c", 8),
        (6, "token = \"abcdef0123456789abcdef01\" mail a.b@c.de +1 (234) 567-8901 10.0.0.1 4111 1111 1111 1111", "en", "a", 9), (7, "a b", "en", "b", 3), (8, "\n\n  \t", "fr", None, 4),
    ]
    return spark.createDataFrame(rows, DOC).withColumns({"_text": F.lit("x"), "key": F.lit(1), "kept": F.lit("no"), "arc": F.lit(0), "words": F.lit("y"), "hash": F.lit(0)})


OPERATORS = {
    "pii": pii.scan, "suffix": suffix_dedup.deduplicate, "secrets": secrets.scan, "near": near_dup.groups, "quality": quality.judge, "mixing": mixing.weights, "shards": sharding.assign,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    df = odd_documents(spark)
    assert OPERATORS[name](df).count() == df.count()
    assert OPERATORS[name](df.limit(0)).count() == 0


def test_filters_keep_columns_on_odd_rows(spark):
    df, bench = odd_documents(spark), spark.createDataFrame([(1, None), (2, "a b c")], "item_id long, text string")
    for out in (quality.keep_good(df), near_dup.keep_one(df), decontaminate.clean(df, bench), mixing.sample(df)):
        assert out.columns == df.columns and out.count() <= df.count()
    assert near_dup.keep_one(df).where("doc_id = 5").count() == 1
    assert decontaminate.overlaps(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("name", queries.ORACLE)
def test_equals_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, DATA)) == rows_of_sql(queries.ORACLE[name])


def documents(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_pii(t):
    ok = {
        "email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 12 <= len(pii.digits_of(m)) <= 19 and pii.luhn(pii.digits_of(m)),
        "phone": lambda m: 9 <= len(pii.digits_of(m)) <= 15,
    }
    return sorted((m.start(), k, m.end()) for k, (name, p) in enumerate(PLAIN.items()) for m in re.finditer(p, t) if ok[name](m[0]))


def test_pii_base_equals_plain_patterns(spark):
    rng = random.Random(1)
    for _ in range(5000):
        t = "".join(rng.choice("a1.@+ -()2") for _ in range(rng.randint(0, 40)))
        assert plain_pii(t) == pii.base_spans(t)
    got = {r.doc_id: r.base_sha256 for r in queries.QUERIES["op1_pii_skip_chain"](spark, DATA).collect()}
    for d, t in documents(spark):
        assert got[d] == hashlib.sha256(pii.said(plain_pii(t)).encode()).hexdigest()


def test_pii_field_held_out():
    import numpy as np

    w, v = pii.trained()
    good = total = 0
    for f, y, e, n in pii.labelled(200, 77):
        p = pii.marginals(f @ w, np.array(e, dtype=int).reshape(-1, 3), v)[:n]
        good, total = good + int((p.argmax(1) == y[:n]).sum()), total + n
    assert good / total > 0.97


def test_pii_messages_equal_enumeration():
    """Exact on trees; near on graphs with loops."""
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(4)
    for edges, bound in (([(0, 1, 0), (1, 2, 1), (1, 3, 2), (3, 4, 0)], 2e-3), ([(0, 4, 1), (1, 4, 1), (2, 4, 1), (3, 4, 1)], 2e-3), ([(0, 1, 0), (1, 2, 0), (2, 3, 0), (0, 4, 1), (2, 4, 1), (3, 4, 1)], 0.1)):
        unary, v = rng.normal(size=(5, 3)), rng.uniform(0, 0.8, size=(3, 3))
        exact = np.zeros((5, 3))
        for y in product(range(3), repeat=5):
            weight = np.exp(sum(unary[k, c] for k, c in enumerate(y)) + sum(v[s, y[i]] for i, j, s in edges if y[i] == y[j]))
            for k, c in enumerate(y):
                exact[k, c] += weight
        exact /= exact.sum(1, keepdims=True)
        assert np.abs(pii.marginals(unary, np.array(edges), v) - exact).max() < bound


def test_pii_field_labels_distant_repeats():
    weights = pii.trained()
    found = lambda t: [(pii.KINDS[k], t[s:e]) for s, k, e in pii.find([t], weights)[0][1]]
    pad = " the thion of ered and in a word" * 30 + " "
    assert found("ref 4111/1111/1111/1111 end") == []
    # a card, then fifty veiled repeats far apart: all get the label that the first has
    text = "card 4111 1111 1111 1111" + (pad + "ref 4111/1111/1111/1111 ") * 50
    assert found(text) == [("card", "4111 1111 1111 1111")] + [("card", "4111/1111/1111/1111")] * 50
    text = "Dr. Amalia Keroth came." + (pad + "then Keroth went ") * 3 + pad + "Amalia too"
    assert found(text) == [("name", "Amalia Keroth")] + [("name", "Keroth")] * 3 + [("name", "Amalia")]
    assert found("Then Keroth went and Amalia too") == [] and found("Dear Reader, a reader reads. Reader" + pad) == []
    assert ("street", "12 Keroth Street") in found("Mr Keroth lives at 12 Keroth Street")
    assert found("account DE89370400440532013000 only") == [("account", "DE89370400440532013000")]
    assert found("ssn 123-45-6789 then") == [("identity", "123-45-6789")] and found("part 123-45-6789") == []
    assert found("order 23904500648960 and nothing else") == []


def test_pii_field_adds_spans_to_a_table(spark):
    rows = [(1, "Dr. Amalia Keroth, card 4111 1111 1111 1111. Keroth said: ref 4111/1111/1111/1111"), (2, "no data here"), (3, None)]
    got = {r.doc_id: r for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_card, got[1].n_spans) == (1, 4) and got[1].spans.count("name:") == 2 and got[2].n_spans == got[3].n_spans == 0


def test_suffix_dedup_equals_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(110))
    docs = [(d, t) for d, t in documents(spark)[:60]] + [(1000 + k, " ".join(word() for _ in range(40 + k)) + " " + passage + " é" * k + " ".join(word() for _ in range(30))) for k in range(6)]
    docs += [(2000, "x" * 1500), (2001, passage[:399]), (2002, passage[:400])]
    short = [word()[:3] for _ in range(52)]  # 52 words in under 400 bytes
    docs += [(3000 + k, f"{word()}{sep}" * 9 + " ".join(short[k % 2 :]) + " end" * k) for k, sep in enumerate(" \n\t  ")]
    docs += [(3010, "a " * 300), (3011, " ".join(f"{k}" * 60 for k in range(55))), (3012, "new " + " ".join(f"{k}" * 60 for k in range(55)))]
    L = suffix_dedup.LENGTH
    raw = {d: t.encode() for d, t in docs}
    count = Counter(b[i : i + L] for b in raw.values() for i in range(len(b) - L + 1))
    windows = {}
    for d, b in raw.items():
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        windows[d] = [(at[k][0], at[k + suffix_dedup.PASSAGE - 1][1]) for k in range(len(at) - suffix_dedup.PASSAGE + 1)]
    passages = Counter(raw[d][lo:hi] for d, spans in windows.items() for lo, hi in spans)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for most in (suffix_dedup.MOST_CONTEXTS, 2):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_bytes) for r in suffix_dedup.deduplicate(df, most).collect()}
        for d, b in raw.items():
            again = bytearray(len(b))
            for lo, hi in windows[d]:
                if passages[b[lo:hi]] > 1:
                    again[lo:hi] = b"\1" * (hi - lo)
            gone = bytearray(len(b))
            for i in range(len(b) - L + 1):
                if count[b[i : i + L]] > 1:
                    gone[i : i + L] = b"\1" * L
            kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
            assert got[d] == (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest(), sum(again)), d


def test_secret_spans_equal_plain_patterns(spark):
    kinds = ((r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6), (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), (r"[0-9a-f]+", lambda m: len(m[0]) >= 24))
    got = {r.doc_id: r.base_sha256 for r in queries.QUERIES["op3_secret_ownership"](spark, DATA).collect()}
    for d, t in documents(spark):
        found = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m))
        assert got[d] == hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in found).encode()).hexdigest()


def test_secret_ownership(spark):
    own, copied, pasted = "Zx9Qw7Er5Ty3Ui1Op8As6Df4", "Mn2Bv4Cx6Zl8Kj1Hg3Fd5Sa7", "Qa1Ws2Ed3Rf4Tg5Yh6Uj7Ik8"
    rows = [(1, f"use {own} here", "a"), (2, f"and {own} too", "b"), (5, "token: token: abcdefgh", "b")]
    rows += [(10 + k, f"see {copied}" + " x" * k, f"s{k}") for k in range(3)] + [(20 + k, f"the same {own}x text", f"s{k}") for k in range(9)]
    rows += [(100 + k, f"paste {k} {pasted}", "a") for k in range(secrets.MOST_REPOSITORIES + 1)]
    r = {x.doc_id: x for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert r[1].spans == "owned:4:28" and r[1].most_repositories == 2 and r[5].n_assign == 0
    assert r[10].spans == "" and r[10].n_copied == 1  # three owners
    assert r[100].spans == "" and r[100].n_copied == 1  # one owner, many repositories
    assert r[20].spans == "owned:9:34" and r[20].most_repositories == 1  # copies of one document are one repository


def test_secret_owned_spans_equal_brute_force(spark):
    bare = r"[A-Za-z0-9_-]{24,}"
    kinds = (*((k.pattern, k.value_group, k.least) for k in secrets.BASE), (bare, 0, 0))
    live = lambda v: bool(re.search("[0-9]", v) and re.search("[A-Za-z]", v) and len(set(v)) >= secrets.LEAST_DISTINCT and not re.search(r"(.)\1{3}", v) and not re.search("example|sample|dummy|changeme|placeholder|your", v.lower()))
    data = DATA.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").collect()
    found = {r.doc_id: {(m.end() - len(m[g]), m.end(), m[g]) for p, g, least in kinds for m in re.finditer(p, r.text or "") if len(m[g]) >= least} for r in docs}
    first = {}
    for r in docs:
        first[r.text] = min(first.get(r.text, r.source), r.source)
    at = {}
    for r in docs:
        for _, _, v in found[r.doc_id]:
            at.setdefault(v, set()).add((r.text, first[r.text]))
    n = 0
    for r in queries.QUERIES["op3_secret_ownership"](spark, data).collect():
        want = sorted((s, e) for s, e, v in found[r.doc_id] if live(v) and len(at[v]) <= secrets.MOST_REPOSITORIES and len({o for _, o in at[v]}) <= secrets.MOST_OWNERS)
        assert [x for x in r.spans.split(",") if x.startswith("owned")] == [f"owned:{s}:{e}" for s, e in want]
        n += len(want)
    assert n > 5


def test_secret_spans_of_very_many_matches(spark):
    text = "é token: abcdef7\n" * 5000
    r = secrets.scan(spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")).first()
    want = ",".join(f"assign:{m.start()}:{m.end()}" for m in re.finditer("token: abcdef7", text))
    assert r.n_assign == 5000 and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_near_dup_paths_agree(spark):
    rng = random.Random(8)
    base = [[f"v{rng.randrange(400)}" for _ in range(120)] for _ in range(4)]
    docs = []
    for k in range(80):
        w = list(base[k % 4])
        for _ in range(rng.randrange(9)):
            w[rng.randrange(120)] = f"e{rng.randrange(9)}"
        docs.append((k, " ".join(w)))
    sets_of = [frozenset(near_dup.shingles(t, 4).tolist()) for _, t in docs]
    up = list(range(80))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(80):
        for j in range(i):
            if 100 * len(sets_of[i] & sets_of[j]) >= 80 * len(sets_of[i] | sets_of[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {k: top(k) for k in range(80)}
    for most in (near_dup.MOST_CLASSES, 3):
        assert {r.doc_id: r.component_id for r in near_dup.groups(df, most_classes=most).collect()} == want


def test_posterior_bounds_hold():
    for read, least in near_dup.least_matches():
        assert 0 < least <= read * near_dup.PERCENT / 100


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(9)
    item = [f"t{rng.randrange(500)}" for _ in range(40)]
    near, far = list(item), list(item)
    for k in range(3, 40, 7):
        near[k] = "zz"
    for k in range(0, 40, 2):
        far[k] = f"z{k}"
    pad = " ".join(f"p{k}" for k in range(30))
    docs = spark.createDataFrame([(1, f"{pad} {' '.join(item).upper()} {pad}"), (2, f"{pad}, {', '.join(near)}"), (3, " ".join(far)), (4, pad), (5, " ".join(item[:15]) + " " + pad)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(docs, bench).collect()}
    assert set(got) == {(1, 7), (2, 7)} and got[1, 7].n_matched_item == 40 and got[1, 7].first_word == 30
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [3, 4, 5]


def test_decontamination_finds_every_allowed_substitution(spark):
    """Short items by every pattern that leaves 80 percent of the words, longer ones by the patterns of four substitutions in 20."""
    from itertools import combinations

    docs, items = [], []
    for n in (1, 3, 5, 6, 7, 8, 10, 11, 12, 15, 20):
        item = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        patterns = list(combinations(range(n), n // 5))
        for wrong in patterns[:: max(1, len(patterns) // 300)] + [(4, 9, 14, 19)] * (n == 20):
            docs.append((1000 * n + len(docs), "p q " + " ".join("zz" if k in wrong else w for k, w in enumerate(item)) + " r"))
        docs.append((-n, " ".join("zz" if k <= n // 5 else w for k, w in enumerate(item))))
    df, bench = (spark.createDataFrame(rows, f"{name} long, text string") for rows, name in ((docs, "doc_id"), (items, "item_id")))
    got = decontaminate.overlaps(df, bench).collect()
    assert len(got) == sum(d > 0 for d, _ in docs) and all(r.doc_id > 0 for r in got)


def test_masks_meet_every_allowed_pattern():
    from itertools import combinations

    for n in range(1, decontaminate.STRETCH + 1):
        placed = [{k + o for o in m} for m in decontaminate.masks_for(n) for k in range(n - m[-1])]
        assert n < 5 or all(m[-1] >= len(m) for m in decontaminate.masks_for(n))  # every mask ignores some position
        assert all(any(not p & set(wrong) for p in placed) for wrong in combinations(range(n), n // 5)), n


def test_decontamination_equals_all_diagonals(spark):
    rng = random.Random(12)
    items = [[f"v{rng.randrange(30)}" for _ in range(rng.choice((2, 4, 5, 7, 9, 12, 15, 19, 24, 33)))] for _ in range(25)]
    items.append(list(items[7]))
    docs = []
    for _ in range(60):
        w = [f"v{rng.randrange(30)}" for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 3)):
            part = [x if rng.random() > 0.18 else "zz" for x in rng.choice(items)]
            w += part[rng.randint(0, 2) :] + [f"v{rng.randrange(30)}" for _ in range(rng.randint(0, 9))]
        docs.append(w)
    want = set()
    for d, w in enumerate(docs):
        for i, x in enumerate(items):
            size = min(20, len(x))
            for shift in range(-len(x) + 1, len(w)):
                hit = [0 <= shift + j < len(w) and w[shift + j] == y for j, y in enumerate(x)]
                if any(100 * sum(hit[k : k + size]) >= 80 * size for k in range(len(x) - size + 1)):
                    want.add((d, i))
    df, bench = (spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], f"{name} long, text string") for rows, name in ((docs, "doc_id"), (items, "item_id")))
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(df, bench).collect()} == want and len(want) > 40


def test_decontamination_without_spaces_and_with_clashing_names(spark):
    item = "".join(chr(0x4E00 + 37 * k) for k in range(24))
    rows = [(1, "前文" + item[:11] + "誤" + item[12:], 1, 2), (2, "別の文章です", 1, 2), (1, "前文" + item[:11] + "誤" + item[12:], 1, 2)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, _id int, _hash int"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(r.doc_id, r.n_matched_item) for r in decontaminate.overlaps(docs, bench).collect()] == [(1, 23)]
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [2]
    assert sorted(r.doc_id for r in near_dup.keep_one(docs).collect()) == [1, 2]


def test_decontamination_in_blocks_and_by_shuffles(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    one = sorted(map(tuple, decontaminate.overlaps(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "MOST_SEEDS", 900)
    monkeypatch.setattr(decontaminate, "MOST_IDS", 0)
    assert sorted(map(tuple, decontaminate.overlaps(docs, bench).collect())) == one
    assert decontaminate.clean(docs, bench).count() == docs.count() - len({d for d, *_ in one})
    whole = [(d, i) for d, t in documents(spark) for i, x in [(r.item_id, r.text) for r in bench.collect()] if x in t]
    assert set(whole) <= {(r[0], r[2]) for r in one}


def test_raking_meets_the_marginals(spark):
    rows = [(k, "w " * (5 + k % 40 * 9), ("en", "de", "fr", "es")[k % 4 if k % 3 else 0], f"s{k % 5}", 0) for k in range(400)]
    df = spark.createDataFrame(rows, DOC)
    w = mixing.weights(df, budget=0.3).toPandas()
    total = (w.tokens * w.weight).sum()
    langs = (w.tokens * w.weight).groupby(w.lang).sum() / total
    assert all(abs(langs[k] - v) < 1e-3 for k, v in mixing.LANG_TARGETS.items())
    t = w.tokens.groupby(w.source).sum() ** mixing.SOURCE_TEMPERATURE
    assert (((w.tokens * w.weight).groupby(w.source).sum() / total - t / t.sum()).abs() < 1e-3).all()
    assert abs((w.tokens * w.probability).sum() / w.tokens.sum() - 0.3) < 1e-3
    assert mixing.sample(df, budget=0.3).count() == int(w.sampled.sum())


def test_raking_equals_another_fit(spark):
    w = mixing.weights(spark.read.parquet(f"{DATA}/documents.parquet")).toPandas()
    cells = w.groupby(["source", "lang", "topic"]).tokens.sum().to_dict()
    p = plain.raked(cells, (w.tokens * w.probability).sum() / w.tokens.sum())
    assert all(abs(r.probability - p[r.source, r.lang, r.topic]) < 1e-3 for r in w.itertuples() if r.tokens)


def drawn_shares(w, by):
    t = w.tokens * w.probability
    return t.groupby(w[by]).sum() / t.sum()


def test_drawn_tokens_meet_the_targets_where_cells_are_capped(spark):
    w = mixing.weights(spark.read.parquet(f"{DATA}/documents.parquet")).toPandas()
    total, topics = w.tokens.sum(), w.tokens.groupby(w.topic).sum()
    wanted = {k: v for k, v in mixing.TOPIC_TARGETS.items() if topics.get(k, 0) > 0}
    wanted = {k: v / sum(wanted.values()) for k, v in wanted.items()}
    t = w.tokens.groupby(w.source).sum() ** mixing.SOURCE_TEMPERATURE
    assert (w.probability >= 1).any() and w.probability.max() <= 1
    assert all(abs(drawn_shares(w, "topic")[k] - v) < 2e-4 for k, v in wanted.items())
    assert all(abs(drawn_shares(w, "lang")[k] - v) < 2e-4 for k, v in mixing.LANG_TARGETS.items())
    assert ((drawn_shares(w, "source") - t / t.sum()).abs() < 2e-4).all()
    # the budget is the largest feasible: the scarcest category is drawn whole
    assert abs((w.tokens * w.probability).sum() / total - min(topics[k] / total / v for k, v in wanted.items())) < 1e-4


def test_chat_round_trip_and_parts(spark):
    hard = "~0 <| <|end|> ~ </s>[INST] ok [/INST]\n~1"
    rows = [(1, 0, "us\ner", hard), (1, 1, "assistant", hard), (1, 2, None, None), (2, 0, "assistant", "")]
    back = {r.conv_id: r for r in chat.read_back(chat.format_texts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("us\ner", hard), ("assistant", hard), ("", "")] and back[1].loss_text == hard and back[2].loss_text == ""
    assert sum(m.n for m in back[1].mask) == len(back[1].formatted)
    parts = [("text", "see ", None), ("image", None, "i.png"), ("audio", None, "a.wav"), ("text", " and <|image|>", None)]
    r = chat.format_parts(spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts {chat.PART}")).first()
    assert r.attachments == ["i.png", "a.wav"] and r.n_tokens == 1 + 576 + 750 + 2 and "<|image|><|audio|> and ~1image|>" in r.formatted


def test_chat_takes_attachments_out_of_texts(spark):
    rng = random.Random(5)
    bits = ["see ", "![a cat](http://x.org/cat.png)", "https://x.org/talk.mp3", "(https://x.org/paper.pdf)", "data:image/png;base64,iVBORw0KGgo=", "data:application/pdf;base64,JVBERi0x", "<|image|>", "~", " </s>[INST]", "\n", "https://x.org/page ", "![odd](", "<|end|>", "é ", "https://x.org/a.docx?x=1"]
    rows = [(c, t, "assistant" if t % 2 else "user", "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for c in range(40) for t in range(rng.randint(1, 5))]
    rows.append((99, 0, "user", " ".join(bits)))
    schema = "conv_id long, turn long, role string, text string"
    back = {r.conv_id: r for r in chat.read_back(chat.format_texts(spark.createDataFrame(rows, schema))).collect()}
    for c in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == c]
        assert [(t.role, t.text) for t in back[c].turns] == [(r[2], r[3]) for r in mine]
        assert back[c].loss_text == "".join(r[3] for r in mine if r[2] == "assistant")
        assert sum(m.n for m in back[c].mask) == len(back[c].formatted)
    assert back[99].attachments == ["![a cat](http://x.org/cat.png)", "https://x.org/talk.mp3", "https://x.org/paper.pdf", "data:image/png;base64,iVBORw0KGgo=", "data:application/pdf;base64,JVBERi0x", "https://x.org/a.docx"]
    assert re.findall(r"<\|(image|audio|document)\|>", back[99].formatted) == ["image", "audio", "document", "image", "document", "document"]
    assert back[99].n_tokens > 2 * 576 + 750 + 3 * 2048 - 1


def test_chat_query_equals_sql_with_attachments(spark, tmp_path):
    texts = ["see ![a](http://x.org/c.png) and https://x.org/t.mp3", "plain <|end|> ~ text", None, "https://x.org/p.pdf", "data:audio/wav;base64,AAAA [INST]"]
    rows = [(k // 3, k % 3, ("user", "assistant", None)[k % 3], texts[k % 5]) for k in range(12)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = c.sql(queries.ORACLE["op8_chat_parts"])
    got = queries.QUERIES["op8_chat_parts"](spark, str(tmp_path))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall()) and got.agg(F.sum("n_attachments")).first()[0] > 8


def test_chat_edge_rows(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "b"), (1, 0, None, None), (1, 0, None, None), (1, 0, "b", "x"), (1, 0, "a", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"parts": F.lit(1), "alone": F.lit(2), "refs": F.lit(3)})
    got = chat.read_back(chat.format_texts(df)).collect()
    assert sorted(len(r.turns) for r in got) == [1, 1, 4]  # rows without an id stay alone
    assert [(t.role, t.text) for t in next(r for r in got if r.conv_id == 1).turns] == [("", ""), ("", ""), ("a", "y"), ("b", "x")]
    assert chat.read_back(chat.format_texts(df.limit(0))).count() == 0


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies, many of them, all the time.</div>
<div id=content><h1>Head &amp; line</h1><p>First   paragraph, with commas, and <b>bold</b>&nbsp;text that is long enough.<p>Second one<br>goes on, and on, until it is long as well.</div>
<div class="sidebar"><p>Other stories, a lot of them, with long texts that go on and on.</p></div><form><p>Your name, please, and your address, too.</p></form>
<section id="comments"><p>I liked this, really, a lot, and more than I can say here.</p></section><footer>Foot</footer><script>if (a < b) { x = "<p>no</p>" }</script></body></html>"""


def test_page_text():
    assert html_text.main_text(PAGE) == "Head & line\n\nFirst paragraph, with commas, and bold text that is long enough.\n\nSecond one goes on, and on, until it is long as well."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("<article><header><h1>H</h1><p>by x</p></header><p>Short.</p><aside>no</aside></article>") == "H\n\nShort."


PLAIN_PAGE = """<body class="has-sidebar"><div id=top><a href=1>One</a> <a href=2>Two</a></div><div class="page"><div><div><h2>Part one</h2><p>The first part, with commas, and words enough to be a paragraph of its own.</p>
<p>More, and more, of the first part, which goes on for quite a while, as parts do.</p></div><div><p>Second part, a single one.</p></div><ul><li>item one<li>item two</ul><pre>code  here</pre></div>
<p>Short end.</p><ul><li><a href=3>Link</a><li><a href=4>Link</a></ul></div>bare words<div class="sidebar">Other</div></body>"""


def test_page_text_without_article_keeps_all_parts():
    assert html_text.main_text(PLAIN_PAGE).split("\n\n") == [
        "Part one", "The first part, with commas, and words enough to be a paragraph of its own.", "More, and more, of the first part, which goes on for quite a while, as parts do.",
        "Second part, a single one.", "item one", "item two", "code here", "Short end.", "bare words",
    ]
    whole = '<div class="related content"><p>All of the text of this page, in fact, stands in a part with an odd name.</p></div>'
    assert html_text.main_text(whole).startswith("All of the text") and html_text.main_text(f"{whole}<p>{'The longer part, by far. ' * 9}</p>").startswith("The longer part")


def test_pages_of_a_megabyte_take_linear_time():
    import time

    body = "<p>Some text, and more, that is long enough to count.</p>"
    hostile = {
        "nesting": "<div>" * 100_000 + body, "inline nesting": "<b><p>" + "<i></b>" * 120_000 + body, "open quotes": body + '<a href="x ' * 90_000, "quotes with an end": body + "<a '" * 200_000 + "'>'",
        "open tags": body + "<a b=c " * 140_000, "lone signs": body + "< " * 500_000, "end tags": "</p></b>" * 120_000 + body, "lists": "<ul><li>" * 100_000 + body, "tables": "<table><tr><td>" * 60_000 + body, "comments": body + "<!-- " * 200_000,
    }
    for name, page in hostile.items():
        t = time.process_time()
        text = html_text.main_text(page)
        assert time.process_time() - t < 15, name
        assert "Some text, and more" in text, name


def test_pages_with_nulls_ties_and_clashing_columns(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>Same text, twice.</p>"), (2, "u", "<p>Same text, twice.</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x")})
    got = html_text.extract(df)
    assert sorted(r.n_chars for r in got.collect()) == [0, 0, 17, 17] and html_text.extract(df.limit(0)).count() == 0


def test_page_text_equals_articles(spark):
    import html

    def truth(h):
        parts = re.split(r"</?(?:p|h1)[^>]*>", re.search(r"<article>(.*)</article>", h, re.S)[1].replace("<br>", " "))
        return "\n\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts) if x)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in queries.QUERIES["op9_html_tree_scoring"](spark, DATA).collect():
        assert r.text == truth(pages[r.page_id]) and r.n_chars == len(r.text)


@pytest.mark.parametrize("chunk", (sharding.CHUNK, 3))
def test_ring_equals_one_by_one(spark, monkeypatch, chunk):
    """Every row walks clockwise by itself, round by round, to the first shard with room."""
    monkeypatch.setattr(sharding, "CHUNK", chunk)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "no id")] * 7 + [(5, "twice")] * 9 + [(5, None), (None, None)], "doc_id long, text string")
    df = docs.unionByName(odd)
    shards, nodes, blocks = 7, 8, 3
    got = sharding.assign(df, shards, nodes, blocks).collect()
    want = plain.walked(plain.ring_keys(df, blocks), shards, nodes)
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot)) for r in got)


def test_ring_moves_little_when_it_grows(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a = {r.doc_id: r.shard for r in sharding.assign(df, 10).collect()}
    b = {r.doc_id: r.shard for r in sharding.assign(df, 11).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.5 * len(a)


def test_window_repeats_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.metrics(df).collect():
        w = texts[r.doc_id].split()
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        assert r.n_repeat_words == len({i + k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(5)})
