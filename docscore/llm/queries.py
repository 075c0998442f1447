"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from docscore.llm import bpe, decontam, embedding_dedup, exact_dedup, importance, licenses, quality, secrets, simhash, substrings, token_counts, toxicity, whitening


def queries() -> dict:
    return {
        "op1_decontamination": decontam.query,
        "op2_license_scan": licenses.query,
        "op3_bpe_round_trip": bpe.query,
        "op4_quality_resampling": quality.query,
        "op5_secret_scan": secrets.query,
        "op6_toxicity": toxicity.query,
        "op7_simhash_near_dedup": simhash.query,
        "op8_substring_dedup": substrings.query,
        "op9_token_counts": token_counts.query,
        "op10_exact_dedup": exact_dedup.query,
        "op11_embedding_whitening": whitening.query,
        "op12_importance_resampling": importance.query,
        "op13_embedding_near_dedup": embedding_dedup.query,
    }


def oracle_sql() -> dict:
    return {
        "op8_substring_dedup": substrings.ORACLE,
        "op10_exact_dedup": exact_dedup.ORACLE,
        "op12_importance_resampling": importance.ORACLE,
    }
