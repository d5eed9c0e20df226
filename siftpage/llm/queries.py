"""The registered queries of this package and their SQL counterparts."""

from __future__ import annotations

from siftpage.llm import (
    bpe_tree,
    chat_format,
    filter_audit,
    kneser_ney,
    label_shards,
    language_id,
    mixing,
    posting_lists,
    pu_quality,
    quality_rules,
    simhash_dedup,
    turn_repair,
    url_filters,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_language_id": language_id.op2_language_id,
    "op3_lm_scoring": kneser_ney.op3_lm_scoring,
    "op4_chat_formatting": chat_format.op4_chat_formatting,
    "op5_url_filters": url_filters.op5_url_filters,
    "op6_simhash_dedup": simhash_dedup.op6_simhash_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_bpe_encoding": bpe_tree.op8_bpe_encoding,
    "op9_nearest_neighbours": posting_lists.op9_nearest_neighbours,
    "op10_quality_classifier": pu_quality.op10_quality_classifier,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_conversation_repair": turn_repair.op12_conversation_repair,
    "op13_label_shards": label_shards.op13_label_shards,
}

SQL = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op4_chat_formatting": chat_format.OP4_SQL,
    "op5_url_filters": url_filters.OP5_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_conversation_repair": turn_repair.OP12_SQL,
}
