"""All queries of the engine and their SQL, gathered from the modules of this folder."""

from __future__ import annotations

from sheaf.plans import extra, metadata, records, scalars, search, services, structure, timed, windows


def _modules():
    return (search, scalars, structure, timed, metadata, records, windows, extra, services)


def queries() -> dict:
    out: dict = {}
    for m in _modules():
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in _modules():
        out |= m.SQL
    return out
