"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from graphloom.llm import codes, fingerprints, language, line_dedup, mixing, neighbours, ngram_join, packing, pii, quality, substring_dedup, toxicity, whitening

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_language_id": language.op3_language_id,
    "op4_nearest_neighbours": neighbours.op4_nearest_neighbours,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_pii_spans": pii.op6_pii_spans,
    "op7_toxicity_chain": toxicity.op7_toxicity_chain,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_ngram_jaccard_join": ngram_join.op9_ngram_jaccard_join,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_fingerprints": fingerprints.op12_fingerprints,
    "op13_vector_codes": codes.op13_vector_codes,
}

SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op5_mix_sources": mixing.OP5_SQL,
    "op9_ngram_jaccard_join": ngram_join.OP9_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
    "op13_vector_codes": codes.OP13_SQL,
}
