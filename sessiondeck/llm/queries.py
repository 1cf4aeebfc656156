"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, decontaminate, language_id, line_dedup, pitman_yor, simhash, spotsigs, token_counts, toxicity, url_filters

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_bpe": bpe.query,
    "op3_token_counts": token_counts.query,
    "op4_url_filters": url_filters.query,
    "op5_decontamination": decontaminate.query,
    "op6_language_id": language_id.query,
    "op7_spotsigs": spotsigs.query,
    "op8_simhash": simhash.query,
    "op9_pitman_yor": pitman_yor.query,
    "op10_line_dedup": line_dedup.query,
}

ORACLES = {
    "op4_url_filters": url_filters.ORACLE_SQL,
    "op10_line_dedup": line_dedup.ORACLE_SQL,
}
