"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paceforge.llm.filter_audit import OP12_SQL, op12_filter_audit
from paceforge.llm.language_id import op9_language_id
from paceforge.llm.license_scan import op11_license_scan
from paceforge.llm.lm_score import op4_lm_score
from paceforge.llm.minhash import op2_minhash
from paceforge.llm.mixing import OP1_SQL, op1_source_mixing
from paceforge.llm.packing import op8_packing
from paceforge.llm.quality_classifier import op6_quality_classifier
from paceforge.llm.quality_rules import op3_quality_rules
from paceforge.llm.tokens import op7_token_counts
from paceforge.llm.url_filter import op10_url_filter
from paceforge.llm.vector_codes import OP13_SQL, op13_vector_codes
from paceforge.llm.vectors import op5_vector_duplicates

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_minhash": op2_minhash,
    "op4_lm_score": op4_lm_score,
    "op5_vector_duplicates": op5_vector_duplicates,
    "op3_quality_rules": op3_quality_rules,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_token_counts": op7_token_counts,
    "op8_packing": op8_packing,
    "op9_language_id": op9_language_id,
    "op10_url_filter": op10_url_filter,
    "op11_license_scan": op11_license_scan,
    "op12_filter_audit": op12_filter_audit,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES: dict[str, str] = {"op1_source_mixing": OP1_SQL, "op12_filter_audit": OP12_SQL, "op13_vector_codes": OP13_SQL}
