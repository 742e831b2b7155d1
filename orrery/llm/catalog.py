"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import conversations, decontam, exact_dedup, html_extract, jaccard, langid, line_dedup, packing, secrets, sharding, tokens, turns, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        html_extract.op1_html_extraction,
        jaccard.op2_ngram_jaccard_join,
        tokens.op3_token_counts,
        url_filter.op4_url_filters,
        line_dedup.op5_line_dedup,
        langid.op6_language_id,
        decontam.op7_benchmark_decontamination,
        exact_dedup.op8_exact_dedup,
        packing.op9_packing,
        secrets.op10_secret_scans,
        conversations.op11_conversation_repair,
        sharding.op12_sharding,
        turns.op13_turn_reassembly,
    )
}

ORACLE_SQL: dict[str, str] = {**url_filter.ORACLE, **line_dedup.ORACLE, **exact_dedup.ORACLE}
