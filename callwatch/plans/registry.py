"""Queries of the reference's own operators, with their DuckDB twins."""

from __future__ import annotations

from callwatch.plans import queries_audio, queries_calls, queries_models, queries_ships

_PARTS = (queries_calls, queries_audio, queries_models, queries_ships)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
