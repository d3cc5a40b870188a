"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from folioframe.llm import ann, bpe, langid, lm, mixing, ngram_join, quality, suffix_dedup, token_counts, toxicity

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_language_id": langid.op3_language_id,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_lm_scoring": lm.op5_lm_scoring,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_suffix_array_dedup": suffix_dedup.op7_suffix_array_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_mixing": mixing.op9_mixing,
    "op10_nearest_neighbours": ann.op10_nearest_neighbours,
}
ORACLES = {"op1_ngram_jaccard_join": ngram_join.ORACLE, "op9_mixing": mixing.ORACLE}
