"""All queries of the core and their SQL twins."""

from __future__ import annotations

from canzona.plans import figures, inquiry, integrity, sound

MODULES = [figures, inquiry, integrity, sound]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
