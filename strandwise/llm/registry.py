"""The subpackage's queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, conversations, decontamination, divergence, html_text, line_dedup, lm_scoring, packing, quality, simhash, substring, token_counts, topk

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_html_extraction": html_text.op4_html_extraction,
    "op5_bpe": bpe.op5_bpe,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_simhash": simhash.op8_simhash,
    "op9_topk_search": topk.op9_topk_search,
    "op10_substring_dedup": substring.op10_substring_dedup,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_decontamination": decontamination.op13_decontamination,
}
ORACLE_SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op7_quality_rules": quality.SQL,
    "op9_topk_search": topk.SQL,
    "op11_source_divergence": divergence.SQL,
    "op12_conversation_repair": conversations.SQL,
    "op13_decontamination": decontamination.SQL,
}
