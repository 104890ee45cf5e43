"""Queries of this subpackage, by the name they are registered under."""

from knotwork.llm import exact_dedup, license_scan, line_quality, mixing, near_dedup, page_text, pieces, quality_rules, token_files, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_page_text": page_text.op2_page_text,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_mixing": mixing.op4_mixing,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_token_files": token_files.op8_token_files,
    "op9_line_quality": line_quality.op9_line_quality,
    "op10_license_scan": license_scan.op10_license_scan,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE_OP1,
    "op5_near_dedup": near_dedup.ORACLE_OP5,
    "op7_quality_rules": quality_rules.ORACLE_OP7,
}
