"""A failure is an error and no result."""

import pytest
from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import functions as F
from quillstone.operators import features, models
from quillstone.plans import wide
from quillstone.sources import shared

DATA = "/root/testdata/sf0.001"
OTHERS = {name for name, *_ in features.COMMENT_FEATURES} - {"rhetoric", "hedges"}
OTHERS_C = {name for name, *_ in features.CONVERSATION_FEATURES} - {"asymmetry", "slope"}


def texts_of(spark):
    return spark.createDataFrame([(1, "Perhaps this is it! Or not."), (2, "no")], "doc_id long, text string")


def messages_of(spark):
    return spark.createDataFrame([(c, t, "SV"[t % 2], f"good words {t}") for c in (1, 2) for t in range(8)], "conv_id long, turn int, speaker string, text string")


def unplanned(s):
    return s.df.select(s.key, F.col("no_such_column").alias("chi_5"))


def test_comment_extractor_without_a_plan_is_an_error(spark):
    lex = wide.lexicons(spark, DATA)
    with pytest.raises(AnalysisException):
        features.comment_features(texts_of(spark), lex, skip=OTHERS, instead={"rhetoric": unplanned})
    failed = {}
    got = features.comment_features(texts_of(spark), lex, skip=OTHERS, instead={"rhetoric": unplanned}, failed=failed).collect()
    assert set(failed) == {"rhetoric"} and all(r.chi_5 is None and r.psi_8 is not None for r in got)


def test_conversation_extractor_without_a_plan_is_an_error(spark):
    lex, bad = wide.lexicons(spark, DATA), {"slope": lambda s: s.df.select(s.key, F.col("no_such_column").alias("phi_12"))}
    with pytest.raises(AnalysisException):
        features.conversation_features(messages_of(spark), lex, skip=OTHERS_C, instead=bad)
    failed = {}
    got = features.conversation_features(messages_of(spark), lex, skip=OTHERS_C, instead=bad, failed=failed).collect()
    assert set(failed) == {"slope"} and all(r.phi_12 is None and r.phi_9 is not None for r in got)


def test_failed_job_of_an_extractor_is_an_error(spark):
    fails = F.udf(lambda t: 1 / 0, "double")
    written = lambda s: shared.materialize(s.df.select(s.key, fails("text").alias("chi_5")), "fails")
    with pytest.raises(PythonException):
        features.comment_features(texts_of(spark), wide.lexicons(spark, DATA), skip=OTHERS, instead={"rhetoric": written}, failed={})


class Cluster:
    """A session on a cluster without a shared folder, as far as shared_dir asks."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"


@pytest.mark.parametrize("rows", ["comments", "conversations"])
def test_missing_shared_folder_is_an_error(spark, monkeypatch, rows):
    monkeypatch.setattr(shared, "shared_dir", lambda session, f=shared.shared_dir: f(Cluster))
    lex = wide.lexicons(spark, DATA)
    with pytest.raises(shared.NoSharedFolder):
        if rows == "comments":
            features.comment_features(texts_of(spark), lex, skip={n for n, *_ in features.COMMENT_FEATURES} - {"punctuation"}, failed={})
        else:
            features.conversation_features(messages_of(spark), lex, skip={n for n, *_ in features.CONVERSATION_FEATURES} - {"yule"}, failed={})


@pytest.mark.parametrize(("said", "rows"), [("no labelled rows", [(k, None, 1.0) for k in range(20)]), ("all labels are 1", [(k, 1, float(k)) for k in range(20)]), ("no labelled row has a value of a", [(k, k % 2, None) for k in range(20)])])
def test_head_that_cannot_be_fitted_is_an_error(spark, said, rows):
    with pytest.raises(ValueError, match=said):
        models.fit_head(spark.createDataFrame(rows, "k int, y int, a double"), ["a"], "y", "k", n=2)


def test_head_without_a_fold_to_choose_by_is_an_error(spark):
    rows = [(k, int(k == 0), float(k)) for k in range(20)]
    with pytest.raises(ValueError, match="holds both classes"):
        models.fit_head(spark.createDataFrame(rows, "k int, y int, a double"), ["a"], "y", "k", n=2)
