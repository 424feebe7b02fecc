"""The text operators' queries and SQL."""

from __future__ import annotations

from wardlight.llm import chat, decontaminate, jaccard, langid, merkle, packing, pii, quality, repair, substrings, toxicity, urls

QUERIES = {
    "op1_ngram_jaccard_join": jaccard.op1_ngram_jaccard_join,
    "op2_url_filters": urls.op2_url_filters,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_token_packing": packing.op4_token_packing,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
    "op7_language_id": langid.op7_language_id,
    "op8_pii_pseudonyms": pii.op8_pii_pseudonyms,
    "op9_substring_dedup": substrings.op9_substring_dedup,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_toxicity": toxicity.op13_toxicity,
}

ORACLE_SQL = {
    "op1_ngram_jaccard_join": jaccard.OP1_SQL,
    "op2_url_filters": urls.OP2_SQL,
    "op3_quality_rules": quality.OP3_SQL,
    "op5_chat_formatting": chat.OP5_SQL,
    "op6_benchmark_decontamination": decontaminate.OP6_SQL,
    "op9_substring_dedup": substrings.OP9_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_conversation_repair": repair.OP12_SQL,
}
