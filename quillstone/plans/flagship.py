"""The flagship query: English comments with affect scores, labels and flags, strongest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import comments
from quillstone.plans import texts
from quillstone.plans.registry import query, table


@query(f"""WITH {texts.TOK}, {texts.LEX}, {texts.AFF} SELECT aff.doc_id, toxic, round((ma * abs(mv))::DECIMAL(18, 9), 6)::DOUBLE AS chi_1, round(neg, 6) AS chi_2, coalesce(ma * abs(mv) > 0.05, false) AS flagged
FROM aff LEFT JOIN labels USING (doc_id)""")
def flagged_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    # chi_1 is taken to nine digits and then, halves up, to six: a half is no matter of the last bit
    s = comments.affect(texts.document_tokens(spark, sf_dir), texts.valued(spark)).join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    chi_1 = comments.arousal_intensity(s)
    return s.select("doc_id", "toxic", F.round(F.round(chi_1, 9), 6).alias("chi_1"), F.round("negative_share", 6).alias("chi_2"), F.coalesce(chi_1 > 0.05, F.lit(False)).alias("flagged")).orderBy(F.desc_nulls_last("chi_1"), "doc_id")


