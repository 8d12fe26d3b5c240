"""All registered queries and their SQL."""

from __future__ import annotations

from . import analysis, gates, handover, learning, lifecycle, monitor_rules, narrative, pages, records, releases, storage, validation, verification, watch

_MODULES = (validation, lifecycle, records, pages, monitor_rules, gates, releases, verification, storage, analysis, learning, narrative, handover, watch)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
