"""Registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op2_bpe
from .itq import op6_embedding_near_dedup
from .knn import op8_nearest_neighbours
from .langid import op10_language_id
from .lines import OP5_SQL, op5_line_dedup
from .mixing import op9_mix_sources
from .orchard import OP13_SQL, op13_vector_codes
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .rans import op7_token_store
from .simhash import op3_simhash_near_dedup
from .substrings import op1_substring_dedup
from .toxicity import op4_toxicity
from .wumanber import OP11_SQL, op11_benchmark_decontamination

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_bpe": op2_bpe,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_token_store": op7_token_store,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_mix_sources": op9_mix_sources,
    "op10_language_id": op10_language_id,
    "op11_benchmark_decontamination": op11_benchmark_decontamination,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL = {"op5_line_dedup": OP5_SQL, "op11_benchmark_decontamination": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_vector_codes": OP13_SQL}
