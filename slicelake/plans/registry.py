"""All core queries and their SQL."""

from __future__ import annotations

from slicelake.plans import counts, files, numbered, reads

MODULES = (numbered, reads, counts, files)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
