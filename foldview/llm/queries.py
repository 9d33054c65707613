"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import extract, imatch, jaccard, packing, pieces, quality, secrets, substring, toxicity, url_filter


def queries():
    return {
        "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
        "op2_substring_dedup": substring.op2_substring_dedup,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_html_extraction": extract.op5_html_extraction,
        "op6_secret_scan": secrets.op6_secret_scan,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_sentencepiece": pieces.op9_sentencepiece,
        "op10_imatch": imatch.op10_imatch,
    }


def oracle_sql():
    return {"op1_ngram_jaccard": jaccard.oracle_sql(), "op2_substring_dedup": substring.oracle_sql(), "op4_url_filter": url_filter.oracle_sql(), "op7_quality_rules": quality.oracle_sql()}
