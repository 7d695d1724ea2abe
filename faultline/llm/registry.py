"""Queries of the corpus operators with their DuckDB oracles."""

from __future__ import annotations

from faultline.llm import decontamination, html_extraction, license_scan, line_dedup, ngram_join, packing, quality_classifier, quality_rules, spelling_variants, substring_dedup, surrogates, url_filter, vector_codes


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_surrogates": surrogates.op3_surrogates,
        "op4_license_scan": license_scan.op4_license_scan,
        "op5_ngram_join": ngram_join.op5_ngram_join,
        "op6_quality_classifier": quality_classifier.op6_quality_classifier,
        "op7_decontamination": decontamination.op7_decontamination,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_packing": packing.op9_packing,
        "op10_substring_dedup": substring_dedup.op10_substring_dedup,
        "op11_html_extraction": html_extraction.op11_html_extraction,
        "op12_spelling_variants": spelling_variants.op12_spelling_variants,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict:
    return {
        "op2_url_filter": url_filter.ORACLE,
        "op7_decontamination": decontamination.ORACLE,
        "op8_quality_rules": quality_rules.ORACLE,
        "op10_substring_dedup": substring_dedup.ORACLE,
        "op11_html_extraction": html_extraction.ORACLE,
        "op12_spelling_variants": spelling_variants.ORACLE,
        "op13_vector_codes": vector_codes.ORACLE,
    }
