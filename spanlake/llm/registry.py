"""Queries and oracle SQL of the training-data operators, by name."""

from __future__ import annotations

from spanlake.llm import decontaminate, fingerprints, html_text, line_dedup, near_dedup, sampled_pieces, sharding, substring_dedup, token_counts, toxicity

QUERIES = {
    "op1_histogram_shards": sharding.op1_histogram_shards,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_html_text": html_text.op6_html_text,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_sampled_pieces": sampled_pieces.op8_sampled_pieces,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLES = {
    "op1_histogram_shards": sharding.ORACLE_SQL,
    "op3_decontaminate": decontaminate.ORACLE_SQL,
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op7_substring_dedup": substring_dedup.ORACLE_SQL,
}
