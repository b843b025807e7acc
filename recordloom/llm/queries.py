"""The registered queries of this package, with their SQL where SQL can say it."""

from __future__ import annotations

from recordloom.llm import conversations, decontaminate, divergence, language, licences, mixing, near_dup, packing, quality, secrets, substrings, toxicity, warc

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_mixing": mixing.op2_mixing,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_warc": warc.op5_warc,
    "op6_secrets": secrets.op6_secrets,
    "op7_licences": licences.op7_licences,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_language_id": language.op9_language_id,
    "op10_near_duplicates": near_dup.op10_near_duplicates,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_packing": packing.op13_packing,
}

ORACLE = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op5_warc": warc.OP5_SQL,
    "op6_secrets": secrets.OP6_SQL,
    "op7_licences": licences.OP7_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
    "op12_conversation_repair": conversations.OP12_SQL,
}
