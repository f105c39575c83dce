"""Every query of the engine's own operators against its SQL, or for its shape where there is none."""

import pytest
from quillstone.plans import ORACLE, QUERIES

from tests.compare import DATA, rows_of, rows_of_sql

@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_equals_sql(spark, name):
    assert rows_of(QUERIES[name](spark, DATA)) == rows_of_sql(ORACLE[name])


#: Queries that SQL cannot express, their id and the table that has one row for each of theirs (none: fewer rows).
WITHOUT_SQL = {
    "q_comment_features": ("doc_id", "documents"), "q_conversation_features": ("conv_id", None), "q_stage_model": ("conv_id", None), "q_out_of_fold": ("doc_id", "labels"),
    "q_plane_removal_sampled": ("id", None), "q_scored_comments": ("doc_id", "documents"),
}


def test_all_queries_are_held_against_something():
    assert {n for n in QUERIES if n not in ORACLE} == set(WITHOUT_SQL)


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_rows_of_queries_without_sql(spark, name):
    key, whole = WITHOUT_SQL[name]
    rows = QUERIES[name](spark, DATA).collect()
    assert rows and all(r[key] is not None for r in rows)
    if whole:
        assert sorted(r[key] for r in rows) == sorted(r[key] for r in spark.read.parquet(f"{DATA}/{whole}.parquet").select(key).collect())
    # every value column has a value somewhere
    assert all(any(r[c] is not None for r in rows) for c in rows[0].asDict() if (name, c) not in {("q_conversation_features", f"phi_{k}") for k in range(1, 20)})


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
