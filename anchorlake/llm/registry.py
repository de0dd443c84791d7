"""The queries over training data, by name."""

from __future__ import annotations

from anchorlake.llm import queries

_MODULES = [queries]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
