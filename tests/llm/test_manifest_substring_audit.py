"""The Merkle manifest, the removal of repeated passages and the filter audit against brute force and on edge cases."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from quillstone.llm import filter_audit, merkle, queries, substring

from tests.llm.test_operators import DOC, odd_documents

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """The top and each leaf's (left, right) siblings, level by level."""
    proofs, nodes = [[] for _ in leaves], [(d, [k]) for k, d in enumerate(leaves)]
    while len(nodes) > 1:
        above = []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for j, (_, below) in enumerate(run):
                for k in below:
                    proofs[k].append(("".join(d for d, _ in run[:j]), "".join(d for d, _ in run[j + 1 :])))
            above.append((digest(d for d, _ in run), [k for _, below in run for k in below]))
        nodes = above
    return nodes[0][0], proofs


def plain_manifest(rows):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, digest(told(r[c]) for c in COLUMNS)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [(sorted(groups[g]), *plain_tree([x[2] for x in sorted(groups[g])])) for g in names]
    root, upper = plain_tree([top for _, top, _ in trees])
    return sorted(((i if known else None, leaf, top, root, tuple(proof + above)) for (leaves, top, proofs), above in zip(trees, upper, strict=True) for (known, i, leaf), proof in zip(leaves, proofs, strict=True)), key=repr)


def found_manifest(df, partition=merkle.PARTITION):
    out = merkle.manifest(df, COLUMNS, "lang", "doc_id", partition=partition)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple((p.left, p.right) for p in r.proof)) for r in out.collect()), key=repr)


@pytest.mark.parametrize("partition", [7, 100_000])
def test_manifest_equals_brute_force(spark, partition):
    """Many groups of one row, a hot one over many partitions, nulls, equal ids and repeated rows."""
    rng = random.Random(3)
    rows = [(k, f"text {k % 50}", "en" if k % 3 else f"l{k % 41}", None if k % 7 == 0 else "s", k) for k in range(300)]
    rows += [(5, "again", "en", "s", 1)] * 40 + [(None, None, None, None, None), (None, "x", "", "", 0), (1, "y", None, "é", 2), (9, "only", "ü", "s", 4)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DOC)
    assert found_manifest(df, partition) == plain_manifest([r.asDict() for r in df.collect()])


def test_manifest_on_odd_rows_and_empty_tables(spark):
    df = odd_documents(spark).withColumns({c: F.lit("clash") for c in ("tree", "part", "at", "leaf", "id", "proof", "top")})
    assert found_manifest(df) == plain_manifest([r.asDict() for r in df.collect()])
    assert found_manifest(df.limit(0)) == []
    assert found_manifest(df.where("doc_id = 7"))[0][4] == ()


def test_proofs_tell_tampered_rows(spark):
    df = spark.createDataFrame([(k, "Aa" if k % 2 else "aa", "en", "s", 2) for k in range(100)], DOC)
    lower = merkle.digest_of([F.lower("text") if c == "text" else F.col(c) for c in COLUMNS])
    out = merkle.manifest(df, COLUMNS, "lang", "doc_id", lower, partition=9)
    got = {r.doc_id: r.same for r in out.select("doc_id", (merkle.folded(F.col("altered")) == F.col("root")).alias("same")).collect()}
    assert got == {k: k % 2 == 0 for k in range(100)}


def test_local_levels_leave_a_small_edge():
    rng = random.Random(5)
    for _ in range(200):
        total = rng.randint(1, 5000)
        start = rng.randint(0, total - 1)
        n = rng.randint(1, total - start)
        levels, ragged = merkle.local_levels([str(k) for k in range(n)], start, total)
        assert len(ragged) <= 14 * len(levels)
        # leaves below the edge are just the leaves given
        below = sorted(k for level, place, _ in ragged for k in range(place * 8**level, min((place + 1) * 8**level, total)))
        assert below == list(range(start, start + n))


def plain_removal(rows):
    """rows (doc_id, text) with the words that stay; equal rows are one document."""
    seen, order = {}, sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for i, t in order:
        words = WORD.findall(t or "")
        gone = set()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if seen.setdefault(window, (i, k)) != (i, k):
                gone.update(range(k, k + 20))
        out[i] = (len(words), len(gone), digest(" ".join(w for k, w in enumerate(words) if k not in gone).split("\0")))
    return out


def passages(seed, n=120):
    """Texts of few different words, that share passages whose edges differ, repeat inside themselves and hold each other."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["É", "a,b", "x" * 300]
    shared = [[rng.choice(words) for _ in range(rng.randint(18, 60))] for _ in range(12)]
    out = []
    for k in range(n):
        parts = []
        for _ in range(rng.randint(1, 6)):
            p = rng.choice(shared)
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            parts += rng.choice([p, p[a:b], p[:b], [rng.choice(words) for _ in range(rng.randint(1, 30))], p + p, ["same"] * rng.randint(15, 45)])
        out.append((k * 3, rng.choice([" ", "\n", " \t"]).join(parts)))
    return out


@pytest.mark.parametrize("most", [substring.MOST_BLOCKS, 2])
def test_repeated_passages_equal_brute_force(spark, most):
    rows = [r for seed in (1, 2) for r in [(i + 1000 * seed, t) for i, t in passages(seed)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.deduplicate(df, most).collect()}
    want = plain_removal(rows)
    assert got == want
    assert sum(n for _, n, _ in want.values()) > 1000


def test_passages_in_odd_rows_and_empty_tables(spark):
    df = odd_documents(spark).withColumns({c: F.lit("clash") for c in ("gram", "block", "text_hash", "place", "lo", "found", "wanted")})
    long = " ".join(f"p{k}" for k in range(25))
    more = spark.createDataFrame([(None, long), (20, long), (20, long), (30, long + " end")], "doc_id long, text string")
    df = df.select("doc_id", "text").unionByName(more)
    got = {}
    for r in substring.deduplicate(df).collect():
        assert got.setdefault((r.doc_id, r.n_words), (r.n_removed, r.kept_sha256)) == (r.n_removed, r.kept_sha256)
    # the row without an id is the earliest; rows with equal id and text are one
    assert got[None, 25][0] == 0 and got[20, 25][0] == 25 and got[30, 26][0] == 25
    # a cycle of 977 words covers all but its first turn, and its copy all but the word at the end
    assert got[3, 30000][0] == 30000 - 977 and got[4, 30001][0] == 30000
    assert substring.deduplicate(odd_documents(spark)).count() == 10
    assert substring.deduplicate(odd_documents(spark).limit(0)).count() == 0



def test_blocks_are_shuffled_once(spark):
    rows = passages(7) + [(None, "a b c d e " * 9)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_hash", F.xxhash64("text"))
    every = substring.found_blocks(docs.select("doc_id", "text_hash", "text"))
    met = substring._met(every)
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    own = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_hash, r.place)
    grams = {}
    for r in every.collect():
        grams.setdefault(r.gram, {}).setdefault(r.block, set()).add(own(r))
    want = {(own_, True, len(g)) for g in grams.values() for b in g.values() for own_ in b - {min(b)}} | {(min(b), False, len(g)) for g in grams.values() if len(g) > 1 for b in g.values()}
    got = {(own(r), r.later, r.n_blocks) for r in met.collect()}
    assert got == want and any(x[1] for x in got) and not all(x[1] for x in got)


def test_wide_grams_meet_the_texts_in_the_plan_of_the_result(spark, monkeypatch):
    rows, written, write = passages(1) + [(i + 1000, t) for i, t in passages(2)], [], substring.materialize
    monkeypatch.setattr(substring, "materialize", lambda df, label: written.append(label) or write(df, label))
    out = substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 2)
    # a table written on the way would shuffle the texts once more
    assert written == ["rlz-met"]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()} == plain_removal(rows)


def test_factors_are_the_longest_earlier_ones():
    rng = np.random.default_rng(2)
    words = rng.integers(1, 3, (300, substring.BLOCK)).astype(np.uint64)
    words[150:] = words[:150]
    for row in range(150, 300):
        words[row, rng.integers(0, substring.BLOCK)] = row
    before, after, gram = np.full(300, substring.BEFORE), np.full(300, substring.WINDOW), np.zeros(300, dtype=np.uint64)
    found = {}
    for row, first, last in zip(*substring.factors(words, before, after, gram), strict=True):
        found.setdefault(int(row), set()).update(range(first, last))
    for row in range(300):
        want = set()
        for s in range(substring.BEFORE + 1):
            if any((words[row, s : s + 20] == words[e, s : s + 20]).all() for e in range(row)):
                want.update(range(s, s + 20))
        assert found.get(row, set()) == want


def plain_audit(docs, labels):
    fails, out, first = [], {}, {}
    for i, t, part in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, part in docs:
        t = t or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        fails.append((part or "", {k for k, v in f.items() if v}, *[any(x[0] == i and x[c] == 1 for x in labels if i is not None) for c in (1, 2)]))
    for part in {p for p, *_ in fails}:
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            alive = [x for x in fails if x[0] == part]
            for step, f in enumerate(order):
                hit = [x for x in alive if f in x[1]]
                alive = [x for x in alive if f not in x[1]]
                every = [x for x in fails if x[0] == part and f in x[1]]
                shapley[f] += len(hit)
                out[part, "".join(order), step + 1] = [len(alive), len(hit), len(every) - len(hit), sum(x[1] == {f} for x in every), sum(x[2] for x in hit), sum(x[3] for x in hit)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def found_audit(df, labels):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in filter_audit.audit(df, labels).collect()}


def test_audit_equals_brute_force_on_odd_rows(spark):
    df = odd_documents(spark).withColumns({c: F.lit("clash") for c in ("A", "B", "part", "good", "filter", "state", "digest")})
    extra = spark.createDataFrame([(k, ["Loud WORDS HERE", "plain words " * 80, "a # b", " ".join(f"v{x}" for x in range(120)), "same row"][k % 5], [None, "en", ""][k % 3], "s", 1) for k in range(20, 60)], DOC)
    df = df.unionByName(extra, allowMissingColumns=True)
    labels = spark.createDataFrame([(k, k % 2, (k // 2) % 2) for k in range(0, 60)] + [(7, 1, 1), (None, 1, 1), (900, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    want = plain_audit([(r.doc_id, r.text, r.lang) for r in df.collect()], [tuple(r) for r in labels.collect()])
    assert found_audit(df, labels) == want
    assert len(want) == 600 * len({p for p, *_ in want})


def test_audit_of_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert found_audit(odd_documents(spark).limit(0), labels) == {}
    assert len(found_audit(odd_documents(spark), labels)) == 600 * 5


def test_walk_visits_every_set_once(spark):
    rows = spark.range(64).select(F.lit("p").alias("part"), F.lit(True).alias("good"), F.lit(False).alias("toxic"), *[(F.col("id").bitwiseAND(1 << k) != 0).alias(f) for k, f in enumerate("ABCDE")])
    walk = filter_audit.Walk(rows)
    assert len(walk.done) == 32 and len(walk.tables) == 31
    edges = walk.edges().collect()
    assert len(edges) == 80
    # half of what is left goes at every edge
    assert all(2 * e.removed == e.alive == 64 >> len(e.state) for e in edges)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_queries_are_registered():
    assert {"op11_merkle_manifest", "op12_substring_rlz", "op13_filter_audit"} <= set(queries.QUERIES) & set(queries.ORACLE)
