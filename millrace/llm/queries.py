"""The queries of this subpackage, and the SQL against which those are held that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, language_id, line_dedup, ngram_join, packing, suffix_dedup, token_counts, topk_search, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": ngram_join.op1,
        "op2_line_dedup": line_dedup.op2,
        "op3_suffix_dedup": suffix_dedup.op3,
        "op4_url_filter": url_filter.op4,
        "op5_language_id": language_id.op5,
        "op6_decontaminate": decontaminate.op6,
        "op7_token_counts": token_counts.op7,
        "op8_packing": packing.op8,
        "op9_chat_format": chat_format.op9,
        "op10_topk_search": topk_search.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": ngram_join.OP1_SQL, "op3_suffix_dedup": suffix_dedup.OP3_SQL, "op10_topk_search": topk_search.OP10_SQL}
