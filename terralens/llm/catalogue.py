"""The queries of the subpackage and their SQL."""

from __future__ import annotations

from . import op1_training_order, op2_exact_dedup, op3_edit_counts, op4_packing, op5_topk, op6_jaccard, op7_hmm, op8_substring, op9_mixing, op10_quality, op11_negatives, op12_embedding_neighbours, op13_alignment

PARTS = (
    op1_training_order, op2_exact_dedup, op3_edit_counts, op4_packing, op5_topk, op6_jaccard, op7_hmm, op8_substring, op9_mixing, op10_quality, op11_negatives, op12_embedding_neighbours, op13_alignment,
)

QUERIES = {key: fn for part in PARTS for key, fn in part.CAT.queries.items()}
SQL = {key: sql for part in PARTS for key, sql in part.CAT.sql.items()}
