"""All queries of the core, by name."""

from __future__ import annotations

from anchorlake.plans import code, knowledge, overturns, references, reports, retrieval, shards, similar, texts, views

_MODULES = [references, overturns, shards, texts, retrieval, similar, reports, code, views, knowledge]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
