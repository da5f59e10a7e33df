"""All core queries and their SQL."""

from __future__ import annotations

from threadloom.plans import corpus, evaluation, memory, preparation, runs, searching, store, totals

_PARTS = (totals, store, searching, memory, runs, corpus, evaluation, preparation)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
