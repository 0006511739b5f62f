"""Every query of the core, and its SQL where SQL can say it."""

from __future__ import annotations

from sonarloom.plans import aggregates, p2, relational, samplers, sequences, signals, storage

_MODULES = (aggregates, relational, sequences, signals, samplers, storage, p2)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
