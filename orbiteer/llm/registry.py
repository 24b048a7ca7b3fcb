"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import clustering, filter_audit, html_text, language_id, line_dedup, mixing, near_dup, packing, pii, simhash, substring_dedup, topk, url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": packing.op1,
        "op2_substring_dedup": substring_dedup.op2,
        "op3_html_text": html_text.op3,
        "op4_mixing": mixing.op4,
        "op5_language_id": language_id.op5,
        "op6_simhash": simhash.op6,
        "simhash_search": simhash.simhash_search,
        "op7_line_dedup": line_dedup.op7,
        "op8_pii": pii.op8,
        "op9_minhash_near_dedup": near_dup.op9,
        "op10_topk_search": topk.op10,
        "op11_ball_tree_clustering": clustering.op11,
        "op12_filter_audit": filter_audit.op12,
        "op13_url_filters": url_filters.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mixing": mixing.OP4_SQL,
        "op7_line_dedup": line_dedup.OP7_SQL,
        "op10_topk_search": topk.OP10_SQL,
        "op11_ball_tree_clustering": clustering.OP11_SQL,
        "op12_filter_audit": filter_audit.OP12_SQL,
        "op13_url_filters": url_filters.OP13_SQL,
    }
