"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from sparkloom.llm import decontamination, exact_dedup, html_text, jaccard_join, licenses, packing, quality, substring_dedup, toxicity, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_html_extraction": html_text.op2_html_extraction,
    "op3_warc": warc.op3_warc,
    "op4_ngram_jaccard_join": jaccard_join.op4_ngram_jaccard_join,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_license_scans": licenses.op8_license_scans,
    "op9_benchmark_decontamination": decontamination.op9_benchmark_decontamination,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}
SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op3_warc": warc.SQL,
    "op4_ngram_jaccard_join": jaccard_join.SQL,
    "op9_benchmark_decontamination": decontamination.SQL,
    "op10_substring_dedup": substring_dedup.SQL,
}
