"""Queries of all operators of this folder with their SQL, where SQL can express them."""

from __future__ import annotations

from kinloom.llm import (
    annotator_queries,
    component_queries,
    packing_queries,
    people_queries,
    residue_queries,
    survivor_queries,
    token_queries,
    visual_queries,
)

_MODULES = (people_queries, survivor_queries, component_queries, visual_queries, annotator_queries, token_queries, packing_queries, residue_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
