"""The queries of this package by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm import exact, idfiles, learning, near, packing, substrings, tokens, vectors

QUERIES = {
    "op1_token_counts": tokens.op1_token_counts,
    "op2_packing": packing.op2_packing,
    "op3_toxicity": learning.op3_toxicity,
    "op4_pstable_vectors": vectors.op4_pstable_vectors,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_quality": learning.op6_quality,
    "op7_bpe_round_trip": tokens.op7_bpe_round_trip,
    "op8_minhash_forest": near.op8_minhash_forest,
    "op9_id_files": idfiles.op9_id_files,
    "op10_exact_dedup": exact.op10_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {"op10_exact_dedup": exact.OP10_SQL}
