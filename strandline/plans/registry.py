"""Every query of the engine and the SQL that states it, by name."""

from __future__ import annotations

from . import analysis, graph, ingest, navigation, upkeep

MODULES = (ingest, graph, analysis, navigation, upkeep)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
