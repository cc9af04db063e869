"""Registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import conversation_repair, decontamination, html_extraction, jaccard_join, language_id, license_scan, line_dedup, mixing, neighbours, sharding, token_files, toxicity, whitening

QUERIES = {
    "op1_sharding": sharding.query,
    "op2_license_scan": license_scan.query,
    "op3_html_extraction": html_extraction.query,
    "op4_mixing": mixing.query,
    "op5_language_id": language_id.query,
    "op6_line_dedup": line_dedup.query,
    "op7_token_files": token_files.query,
    "op8_neighbours": neighbours.query,
    "op9_decontamination": decontamination.query,
    "op10_jaccard_join": jaccard_join.query,
    "op11_whitening": whitening.query,
    "op12_conversation_repair": conversation_repair.query,
    "op13_toxicity": toxicity.query,
}

ORACLE_SQL = {
    "op2_license_scan": license_scan.ORACLE_SQL,
    "op4_mixing": mixing.ORACLE_SQL,
    "op6_line_dedup": line_dedup.ORACLE_SQL,
    "op9_decontamination": decontamination.ORACLE_SQL,
    "op10_jaccard_join": jaccard_join.ORACLE_SQL,
    "op12_conversation_repair": conversation_repair.ORACLE_SQL,
}
