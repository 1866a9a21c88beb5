"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from sparkloom.llm import bpe, chat, dedup, fingerprint, licenses, packing, quality, sharding, toxicity, urlfilter

QUERIES = {
    "op1_fingerprints": fingerprint.op1_fingerprints,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_sharding": sharding.op3_sharding,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_url_filters": urlfilter.op5_url_filters,
    "op6_minhash_dedup": dedup.op6_minhash_dedup,
    "op7_packing": packing.op7_packing,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_chat_windows": chat.op9_chat_windows,
    "op10_license_scan": licenses.op10_license_scan,
}
ORACLE_SQL = {
    "op3_sharding": sharding.OP3_SQL,
    "op4_quality_rules": quality.OP4_SQL,
    "op5_url_filters": urlfilter.OP5_SQL,
    "op10_license_scan": licenses.OP10_SQL,
}
