"""Queries of the corpus operators and the DuckDB SQL they are held against."""

from __future__ import annotations

from . import exact_dedup, line_dedup, lm_scoring, mixing, near_dedup, packing, quality_classifier, quality_rules, substring_dedup, url_filters

QUERIES = {
    "op1_quality_classifier": quality_classifier.op1_quality_classifier,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op7_mixing": mixing.op7_mixing,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_packing": packing.op10_packing,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op4_quality_rules": quality_rules.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op8_url_filters": url_filters.ORACLE,
    "op9_near_dedup": near_dedup.ORACLE,
}
