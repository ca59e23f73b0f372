"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from askloom.llm import decontamination, filter_audit, html_extraction, line_dedup, lm_scoring, ngram_join, packing, pii, quality_rules, resampling, suffix_dedup, token_counts, warc_zip


def queries() -> dict:
    return {
        "op1_pii": pii.op1_pii,
        "op2_packing": packing.op2_packing,
        "op3_warc_zip": warc_zip.op3_warc_zip,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_lm_scoring": lm_scoring.op5_lm_scoring,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_ngram_join": ngram_join.op8_ngram_join,
        "op9_html_extraction": html_extraction.op9_html_extraction,
        "op10_decontamination": decontamination.op10_decontamination,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_resampling": resampling.op12_resampling,
        "op13_line_dedup": line_dedup.op13_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc_zip": warc_zip.ORACLE,
        "op4_quality_rules": quality_rules.oracle(),
        "op8_ngram_join": ngram_join.ORACLE,
        "op10_decontamination": decontamination.ORACLE,
        "op11_filter_audit": filter_audit.ORACLE,
        "op12_resampling": resampling.oracle(),
        "op13_line_dedup": line_dedup.ORACLE,
    }
