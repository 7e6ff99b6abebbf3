"""The operators as queries on the test tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm import centroids, lexical
from cohortloom.llm.centroids import op12_centroid_clustering
from cohortloom.llm.decontamination import op8_decontamination
from cohortloom.llm.language import op6_language_id
from cohortloom.llm.language_model import op3_language_model
from cohortloom.llm.lexical import op13_lexical_search
from cohortloom.llm.lines import op10_line_dedup
from cohortloom.llm.near_duplicates import op2_near_duplicates
from cohortloom.llm.pieces import op5_sentencepiece
from cohortloom.llm.pii import op1_pii
from cohortloom.llm.quality import op7_quality
from cohortloom.llm.rules import op9_quality_rules
from cohortloom.llm.token_counts import op11_token_counts
from cohortloom.llm.toxicity import op4_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_language_model": op3_language_model,
    "op4_toxicity": op4_toxicity,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_language_id": op6_language_id,
    "op7_quality": op7_quality,
    "op8_decontamination": op8_decontamination,
    "op9_quality_rules": op9_quality_rules,
    "op10_line_dedup": op10_line_dedup,
    "op11_token_counts": op11_token_counts,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_lexical_search": op13_lexical_search,
}
SQL: dict[str, str] = {"op12_centroid_clustering": centroids.SQL, "op13_lexical_search": lexical.SQL}
