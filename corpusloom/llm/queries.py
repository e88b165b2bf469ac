"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from corpusloom.llm import attention_lm, bpe, chat, fim, hyperminhash, mixing, passages, periodic, quality, rules, simhash, token_counts, topk

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_quality_classifier": quality.query,
    "op3_chat_format": chat.query,
    "op4_attention_lm": attention_lm.query,
    "op5_bpe_round_trip": bpe.query,
    "op6_substring_dedup": passages.query,
    "op7_exact_top_k": topk.query,
    "op8_quality_rules": rules.query,
    "op9_simhash_near_dedup": simhash.query,
    "op10_token_counts": token_counts.query,
    "op11_hyperminhash_near_dedup": hyperminhash.query,
    "op12_fill_in_middle": fim.query,
    "op13_periodic_runs": periodic.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": chat.SQL,
    "op7_exact_top_k": topk.SQL,
    "op8_quality_rules": rules.SQL,
    "op12_fill_in_middle": fim.SQL,
}
