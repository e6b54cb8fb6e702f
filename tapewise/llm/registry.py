"""Queries and SQL of all operators in this subpackage."""

from __future__ import annotations

from . import q_learned_index, q_mixing, q_ngram_join, q_pieces, q_quality, q_quotes, q_secrets_scan, q_substring_dedup, q_topk_join, q_toxicity

MODULES = (q_mixing, q_toxicity, q_quality, q_substring_dedup, q_ngram_join, q_secrets_scan, q_pieces, q_topk_join, q_learned_index, q_quotes)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
