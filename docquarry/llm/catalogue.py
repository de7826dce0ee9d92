"""The registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from docquarry.llm import decontamination, line_dedup, lm_score, ngram_join, packing, pii, quality_crf, quality_rules, secrets, url_filter

QUERIES = {
    "op1_packing": packing.query,
    "op2_pii": pii.query,
    "op3_lm_score": lm_score.query,
    "op4_secrets": secrets.query,
    "op5_ngram_join": ngram_join.query,
    "op6_line_dedup": line_dedup.query,
    "op7_decontamination": decontamination.query,
    "op8_quality_rules": quality_rules.query,
    "op9_quality_crf": quality_crf.query,
    "op10_url_filter": url_filter.query,
}

ORACLES = {
    "op5_ngram_join": ngram_join.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
}
