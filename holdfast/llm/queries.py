"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from holdfast.llm import op1_minhash, op10_substrings, op2_classifier, op3_bpe, op4_rules, op5_secrets, op6_packing, op7_chat, op8_fingerprint, op9_lines

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash.query,
    "op2_quality_classifier": op2_classifier.query,
    "op3_bpe_encoding": op3_bpe.query,
    "op4_quality_rules": op4_rules.query,
    "op5_secret_scans": op5_secrets.query,
    "op6_retrieval_packing": op6_packing.query,
    "op7_chat_formatting": op7_chat.query,
    "op8_document_fingerprints": op8_fingerprint.query,
    "op9_line_dedup": op9_lines.query,
    "op10_substring_dedup": op10_substrings.query,
}
SQL = {
    "op1_minhash_near_dedup": op1_minhash.SQL,
    "op4_quality_rules": op4_rules.SQL,
    "op7_chat_formatting": op7_chat.SQL,
    "op9_line_dedup": op9_lines.SQL,
}
