"""Blank, empty and missing texts against the SQL."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from quillstone.plans import texts, wide
from quillstone.plans.registry import ORACLE

from tests.compare import rows_of, rows_of_sql


@pytest.mark.parametrize("query", [texts.q_ai_phrases, texts.q_hedges])
def test_blank_texts_have_a_rate(spark, tmp_path, query):
    said = ["", "  \n\t ", None, "Moreover, the state of the art is the best, perhaps.", "?!", "nothing here"]
    pq.write_table(pa.table({"doc_id": list(range(len(said))), "text": said}), tmp_path / "documents.parquet")
    assert rows_of(query(spark, str(tmp_path))) == rows_of_sql(ORACLE[query.__name__], str(tmp_path))


def test_blank_texts_have_no_rate_in_a_row(spark):
    df = spark.createDataFrame([(1, " \n"), (2, "perhaps moreover"), (3, "nothing")], "doc_id long, text string")
    skip = {name for name, *_ in wide.features.COMMENT_FEATURES} - {"phrases", "hedges"}
    got = {r.doc_id: (r.psi_6, r.psi_8) for r in wide.features.comment_features(df, wide.lexicons(spark, "/root/testdata/sf0.001"), skip=skip).collect()}
    assert got[1] == (None, None) and got[2][0] > 0 and got[2][1] == 50 and got[3] == (0, 0)
