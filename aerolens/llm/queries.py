"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from aerolens.llm import (
    op1_minhash,
    op2_warc,
    op3_packing,
    op4_secrets,
    op5_toxicity,
    op6_mixing,
    op7_topk,
    op8_chat,
    op9_sharding,
    op10_quality,
    op11_simhash,
    op12_search,
    op13_codes,
)

QUERIES = {
    "op1_minhash_near_duplicates": op1_minhash.query,
    "op2_warc_roundtrip": op2_warc.query,
    "op3_vector_packing": op3_packing.query,
    "op4_secret_findings": op4_secrets.query,
    "op5_toxicity_scores": op5_toxicity.query,
    "op6_pfair_mixing": op6_mixing.query,
    "op7_exact_topk": op7_topk.query,
    "op8_chat_format": op8_chat.query,
    "op9_balanced_shards": op9_sharding.query,
    "op10_quality_rules": op10_quality.query,
    "op11_simhash_near_duplicates": op11_simhash.query,
    "op12_lexical_search": op12_search.query,
    "op13_vector_codes": op13_codes.query,
}

#: queries that SQL can express over whole tables
ORACLE: dict[str, str] = {
    "op2_warc_roundtrip": op2_warc.ORACLE_SQL,
    "op7_exact_topk": op7_topk.ORACLE_SQL,
    "op8_chat_format": op8_chat.ORACLE_SQL,
    "op12_lexical_search": op12_search.ORACLE_SQL,
    "op13_vector_codes": op13_codes.ORACLE_SQL,
}
