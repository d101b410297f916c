"""Queries of the corpus operators, and SQL where SQL can express a result."""

from __future__ import annotations

from plinth.llm import hamming, language, licenses, mixing, neardup, negatives, packing, pieces, quality_model, quality_rules, urls, variants, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_license_scan": licenses.query,
    "op3_exact_top_k": hamming.query,
    "op4_packing": packing.query,
    "op5_url_filter": urls.query,
    "op6_minhash_near_dedup": neardup.query,
    "op7_quality_rules": quality_rules.query,
    "op8_sentencepiece": pieces.query,
    "op9_quality_classifier": quality_model.query,
    "op10_language_id": language.query,
    "op11_source_mixing": mixing.query,
    "op12_spelling_variants": variants.query,
    "op13_hard_negatives": negatives.query,
}

ORACLES = {
    "op1_warc": warc.ORACLE_SQL,
    "op2_license_scan": licenses.ORACLE_SQL,
    "op3_exact_top_k": hamming.ORACLE_SQL,
    "op5_url_filter": urls.ORACLE_SQL,
    "op11_source_mixing": mixing.ORACLE_SQL,
    "op12_spelling_variants": variants.ORACLE_SQL,
    "op13_hard_negatives": negatives.ORACLE_SQL,
}
