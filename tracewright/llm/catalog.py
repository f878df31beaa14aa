"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from tracewright.llm.chat_windows import OP12_SQL, op12_chat_windows
from tracewright.llm.collision import op2_collision_counting
from tracewright.llm.divergence import OP11_SQL, op11_source_divergence
from tracewright.llm.fill_in_middle import OP13_SQL, op13_fill_in_middle
from tracewright.llm.html_text import op5_html_main_text
from tracewright.llm.language_id import op6_language_id
from tracewright.llm.mixing import op10_mix_sources
from tracewright.llm.multi_index import OP1_SQL, op1_exact_hamming_top_k
from tracewright.llm.pieces import op7_n_best_pieces
from tracewright.llm.private_data import op4_private_data
from tracewright.llm.secrets import op8_secret_scan
from tracewright.llm.simhash import op3_simhash_near_dedup
from tracewright.llm.token_files import op9_token_files

QUERIES = {
    "op1_exact_hamming_top_k": op1_exact_hamming_top_k,
    "op2_collision_counting": op2_collision_counting,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_private_data": op4_private_data,
    "op5_html_main_text": op5_html_main_text,
    "op6_language_id": op6_language_id,
    "op7_n_best_pieces": op7_n_best_pieces,
    "op8_secret_scan": op8_secret_scan,
    "op9_token_files": op9_token_files,
    "op10_mix_sources": op10_mix_sources,
    "op11_source_divergence": op11_source_divergence,
    "op12_chat_windows": op12_chat_windows,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL: dict[str, str] = {"op1_exact_hamming_top_k": OP1_SQL, "op11_source_divergence": OP11_SQL, "op12_chat_windows": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
