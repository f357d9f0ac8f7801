"""Queries of the corpus operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from redactory.llm.chat import OP7_SQL, op7_chat_format
from redactory.llm.decontaminate import op2_decontaminate
from redactory.llm.line_dedup import OP8_SQL, op8_line_dedup
from redactory.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from redactory.llm.lm_score import op1_lm_score
from redactory.llm.near_dedup import op5_near_dedup
from redactory.llm.packing import op4_packing
from redactory.llm.permutation_index import op13_nearest_neighbours
from redactory.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from redactory.llm.repetition import op6_quality_rules
from redactory.llm.substring_dedup import op10_substring_dedup
from redactory.llm.toxicity import op9_toxicity
from redactory.llm.url_filter import ALIASES_SQL, OP3_SQL, op3_url_filter, url_aliases

QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_decontaminate": op2_decontaminate,
    "op3_url_filter": op3_url_filter,
    "op4_packing": op4_packing,
    "op5_near_dedup": op5_near_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_chat_format": op7_chat_format,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "url_aliases": url_aliases,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}
ORACLE_SQL = {
    "op3_url_filter": OP3_SQL,
    "op7_chat_format": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op11_hard_negatives": OP11_SQL,
    "url_aliases": ALIASES_SQL,
    "op12_prefix_trie": OP12_SQL,
}
