"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from .collocations import OP13_SQL, op13_collocations
from .divergence_rules import OP4_SQL, op4_divergence_rules
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .html_text import op10_html_text
from .merkle_manifest import OP11_SQL, op11_merkle_manifest
from .ordinal_quality import op3_ordinal_quality
from .patience_lines import op8_patience_lines
from .piece_tokens import op12_piece_tokens
from .shingle_join import OP7_SQL, op7_shingle_join
from .source_mix import OP9_SQL, op9_source_mix
from .suffix_tree_lm import op2_suffix_tree_lm
from .suffix_dedup import op6_suffix_dedup
from .swap_packing import op5_swap_packing

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_suffix_tree_lm": op2_suffix_tree_lm,
    "op3_ordinal_quality": op3_ordinal_quality,
    "op4_divergence_rules": op4_divergence_rules,
    "op5_swap_packing": op5_swap_packing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_shingle_join": op7_shingle_join,
    "op8_patience_lines": op8_patience_lines,
    "op9_source_mix": op9_source_mix,
    "op10_html_text": op10_html_text,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_piece_tokens": op12_piece_tokens,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL = {
    "op1_exact_dedup": OP1_SQL,
    "op4_divergence_rules": OP4_SQL,
    "op7_shingle_join": OP7_SQL,
    "op9_source_mix": OP9_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op13_collocations": OP13_SQL,
}
