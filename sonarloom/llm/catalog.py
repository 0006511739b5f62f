"""Every query of this subpackage, and its SQL where SQL can say it."""

from __future__ import annotations

from sonarloom.llm import p1, p3, p4, p5, p6, p7, p8

_MODULES = (p1, p3, p4, p5, p6, p7, p8)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
