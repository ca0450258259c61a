"""The queries of this subpackage, one for each numbered operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import centroids, chat, filter_audit, near_dup, quality
from spindrift.llm.centroids import op13_centroid_clustering
from spindrift.llm.chat import op5_chat_formatting
from spindrift.llm.decontaminate import op3_decontamination
from spindrift.llm.filter_audit import op11_filter_audit
from spindrift.llm.html_text import op9_html_extraction
from spindrift.llm.near_dup import op6_near_dedup
from spindrift.llm.packing import op1_best_fit_packing
from spindrift.llm.piecewise_hash import op12_document_fingerprints
from spindrift.llm.quality import op7_quality_rules
from spindrift.llm.sharding import op2_sharding
from spindrift.llm.token_counts import op10_token_counts
from spindrift.llm.token_files import op4_token_files
from spindrift.llm.url_filter import op8_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_sharding": op2_sharding,
    "op3_decontamination": op3_decontamination,
    "op4_token_files": op4_token_files,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_near_dedup": op6_near_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_url_filter": op8_url_filter,
    "op9_html_extraction": op9_html_extraction,
    "op10_token_counts": op10_token_counts,
    "op11_filter_audit": op11_filter_audit,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLE_SQL: dict[str, str] = {
    "op5_chat_formatting": chat.ORACLE_SQL,
    "op6_near_dedup": near_dup.ORACLE_SQL,
    "op7_quality_rules": quality.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op13_centroid_clustering": centroids.ORACLE_SQL,
}
