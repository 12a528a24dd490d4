"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from . import op1_quality_rules, op10_substring_dedup, op11_merkle_manifest, op12_ngram_join, op13_filter_audit, op2_token_counts, op3_minhash_dedup, op4_decontamination, op5_quality_crf, op6_license_scans, op7_language_id, op8_byte_bpe, op9_url_filters


def queries():
    return {
        "op1_quality_rules": op1_quality_rules.query,
        "op2_token_counts": op2_token_counts.query,
        "op3_minhash_dedup": op3_minhash_dedup.query,
        "op4_decontamination": op4_decontamination.query,
        "op5_quality_crf": op5_quality_crf.query,
        "op6_license_scans": op6_license_scans.query,
        "op7_language_id": op7_language_id.query,
        "op8_byte_bpe": op8_byte_bpe.query,
        "op9_url_filters": op9_url_filters.query,
        "op10_substring_dedup": op10_substring_dedup.query,
        "op11_merkle_manifest": op11_merkle_manifest.query,
        "op12_ngram_join": op12_ngram_join.query,
        "op13_filter_audit": op13_filter_audit.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": op1_quality_rules.SQL,
        "op3_minhash_dedup": op3_minhash_dedup.SQL,
        "op4_decontamination": op4_decontamination.SQL,
        "op6_license_scans": op6_license_scans.sql(),
        "op9_url_filters": op9_url_filters.sql(),
        "op11_merkle_manifest": op11_merkle_manifest.sql(),
        "op12_ngram_join": op12_ngram_join.SQL,
        "op13_filter_audit": op13_filter_audit.SQL,
    }
