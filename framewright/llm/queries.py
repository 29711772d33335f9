"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from framewright.llm import bpe, chat_format, decontaminate, langid, line_dedup, minhash_dedup, pii, pivot_index, toxicity, url_rules

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_pii_pseudonyms": pii.query,
    "op3_embedding_near_dedup": pivot_index.query,
    "op4_benchmark_decontamination": decontaminate.query,
    "op5_toxicity": toxicity.query,
    "op6_minhash_near_dedup": minhash_dedup.query,
    "op7_language_id": langid.query,
    "op8_chat_formatting": chat_format.query,
    "op9_url_filters": url_rules.query,
    "op10_byte_bpe": bpe.query,
}

ORACLE: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op4_benchmark_decontamination": decontaminate.ORACLE,
    "op8_chat_formatting": chat_format.ORACLE,
    "op9_url_filters": url_rules.ORACLE,
}
