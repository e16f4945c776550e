"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from quire.llm import ann, decontamination, licenses, lm, mixing, near_dup, quality, sharding, substring_dedup, tokens

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_sharding": sharding.query,
    "op3_lm_scores": lm.query,
    "op4_licenses": licenses.query,
    "op5_near_dup": near_dup.query,
    "op6_tokens": tokens.query,
    "op7_ann": ann.query,
    "op8_decontamination": decontamination.query,
    "op9_substring_dedup": substring_dedup.query,
    "op10_quality": quality.query,
}
ORACLE_SQL = {
    "op1_mixing": mixing.SQL,
    "op4_licenses": licenses.SQL,
    "op5_near_dup": near_dup.SQL,
    "op9_substring_dedup": substring_dedup.SQL,
}
