"""The queries of the corpus operators by name, and their SQL."""

from __future__ import annotations

from . import decontamination, fill_in_middle, html_extraction, jaccard_join, language_id, minhash_dedup, oracles, packing, quality_classifier, quality_rules, sharding, token_files, url_filter, whitening

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_packing": packing.op3_packing,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_html_extraction": html_extraction.op6_html_extraction,
    "op7_language_id": language_id.op7_language_id,
    "op8_sharding": sharding.op8_sharding,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_token_files": token_files.op10_token_files,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_whitening": whitening.op12_whitening,
    "op13_minhash_dedup": minhash_dedup.op13_minhash_dedup,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
