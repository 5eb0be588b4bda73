"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from variorum.llm import queries

QUERIES = {name: f for name, f in vars(queries).items() if name.startswith("op") and callable(f)}
ORACLES = dict(queries.ORACLES)
