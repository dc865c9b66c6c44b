"""Queries and SQL of this subpackage, for __spark_entry__."""

from __future__ import annotations

from . import chat_format, divergence, exact_dedup, filter_audit, line_dedup, near_dup, piece_queries, secrets, source_mix, token_file, toxicity, vector_links


def queries() -> dict:
    return {
        "op1_token_file": token_file.op1_token_file,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_sentencepiece_prefix": piece_queries.op5_sentencepiece_prefix,
        "op6_secret_scan": secrets.op6_secret_scan,
        "op7_pivot_links": vector_links.op7_pivot_links,
        "op8_token_counts": piece_queries.op8_token_counts,
        "op9_minhash_bayes": near_dup.op9_minhash_bayes,
        "op10_source_mix": source_mix.op10_source_mix,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_chat_format": chat_format.op13_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.OP2_SQL,
        "op3_line_dedup": line_dedup.OP3_SQL,
        "op7_pivot_links": vector_links.OP7_SQL,
        "op9_minhash_bayes": near_dup.OP9_SQL,
        "op11_filter_audit": filter_audit.OP11_SQL,
        "op12_source_divergence": divergence.OP12_SQL,
        "op13_chat_format": chat_format.OP13_SQL,
    }
