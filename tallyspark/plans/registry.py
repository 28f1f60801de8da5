"""All queries of the evidence operators, by name, and their SQL."""

from __future__ import annotations

from . import queries_cash, queries_parties, queries_sources, queries_workspace

PARTS = (queries_cash, queries_parties, queries_sources, queries_workspace)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
