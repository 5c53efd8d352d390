"""Names of the text operators' queries, and their SQL."""

from __future__ import annotations

from . import decontamination, ngram_jaccard, packing, quality_rules, secret_scan, substring_dedup, suffix_dedup, token_counts, toxicity, warc


def queries():
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_decontamination": decontamination.op3_decontamination,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_secret_scan": secret_scan.op5_secret_scan,
        "op6_packing": packing.op6_packing,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_warc": warc.op8_warc,
        "op10_ngram_jaccard": ngram_jaccard.op10_ngram_jaccard,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    }


def oracle_sql():
    return {
        "op2_quality_rules": quality_rules.oracle(),
        "op3_decontamination": decontamination.oracle(),
        "op4_suffix_dedup": suffix_dedup.oracle(),
        "op8_warc": warc.oracle(),
        "op9_substring_dedup": substring_dedup.oracle(),
        "op10_ngram_jaccard": ngram_jaccard.oracle(),
    }
