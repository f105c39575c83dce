"""The pipeline's stages against plain versions, stage by stage and as a whole, over the smallest tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from quillstone.llm import mixing, queries

from tests.compare import DATA, rows_of_sql
from tests.llm import plain

SHARDS, NODES, BLOCKS = 40, 64, 64


@pytest.fixture(scope="module")
def expected(spark):
    """The ids that each stage leaves, and the shards, by the plain versions."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    items = [r.text or "" for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    names, rows = rows_of_sql(queries.ORACLE["op6_quality_rules"])
    good = {r[names.index("doc_id")] for r in rows if r[names.index("kept")]}
    one = plain.nearest_ids([(i, text[i]) for i in sorted(good)], 5)
    clean = one - plain.contaminated([(i, text[i]) for i in sorted(one)], items)
    left = docs.where(F.col("doc_id").isin(*clean))
    rows = mixing.described(left).select("doc_id", "_source", "_lang", "_topic", "_tokens", "_hash").collect()
    cells = {}
    for r in rows:
        cells[r._source, r._lang, r._topic] = cells.get((r._source, r._lang, r._topic), 0) + r._tokens
    fitted = mixing.weights(left).toPandas()
    budget = (fitted.tokens * fitted.probability).sum() / fitted.tokens.sum()
    p = plain.raked(cells, budget)
    draw = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))), F.lit(1 << 40)) / float(1 << 40)
    u = {r.doc_id: r.u for r in left.select("doc_id", draw.alias("u")).collect()}
    chance = {r.doc_id: p.get((r._source, r._lang, r._topic), budget) for r in rows}
    drawn = {i for i in u if u[i] < chance[i]}
    near = {i for i in u if abs(u[i] - chance[i]) < 2e-3}  # too close to call by another fit
    assert not near, near
    placed = plain.walked(plain.ring_keys(docs.where(F.col("doc_id").isin(*drawn)), BLOCKS), SHARDS, NODES)
    return good, one, clean, drawn, placed


def test_stages(spark, expected):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]
    for (name, stage), want in zip(corpus_pipeline.STAGES[:4], expected[:4], strict=True):
        rows = stage(spark, docs, DATA)
        assert rows.columns == docs.columns
        got = rows.collect()
        assert sorted(r.doc_id for r in got) == sorted(want), name
        docs = spark.createDataFrame(got, docs.schema)
    assert 0 < len(expected[3]) < len(expected[2]) < len(expected[1]) < len(expected[0])


def test_run(spark, expected):
    got = corpus_pipeline.run(spark, DATA).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert sorted(map(tuple, got)) == sorted(expected[4])


def test_stages_on_odd_rows(spark):
    """Nulls in every column, repeated rows, clashing names, an empty table: every stage gives its columns and no error."""
    rows = [(1, None, None, None, None), (None, "some words " * 9, None, None, 3), (2, "one two three four five six seven eight nine ten eleven " * 3, "en", "a", 1), (2, "one two three four five six seven eight nine ten eleven " * 3, "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"row": F.lit(1), "_id": F.lit(2), "_hash": F.lit(3), "text_hash": F.lit(4), "kept": F.lit("x")})
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, DATA)
            assert out.columns == df.columns and out.count() <= docs.count(), name
        assert corpus_pipeline.STAGES[4][1](spark, docs, DATA).count() == docs.count()
