"""Independent SQL for the registered queries, run by DuckDB on the same tables.

The SQL states each result in the plainest form (self-joins, range joins, one
window per value), not in the form the library computes it.
"""

from __future__ import annotations

import re

from oracles import events, features, fixture, matches, pairs, players, tables

CTES: dict[str, str] = {
    **fixture.CTES,
    **events.CTES,
    **matches.CTES,
    **features.CTES,
    **players.CTES,
    **pairs.CTES,
}


def _kept(name: str) -> str:
    """Fits read the step before several times, so it is computed once."""
    return "MATERIALIZED " if "_fit" in name or name.endswith("_design") else ""


def _with(select: str) -> str:
    """Prepend the common table expressions a query needs, and those they need."""
    if select.lstrip().startswith("WITH"):
        select = f"SELECT * FROM ({select})"
    needed, text = [], select
    for name in reversed(CTES):
        if re.search(rf"\b{name}\b", text):
            needed.append(name)
            text += "\n" + CTES[name]
    if not needed:
        return select
    parts = [f"{name} AS {_kept(name)}({CTES[name].strip()})" for name in reversed(needed)]
    recursive = "RECURSIVE " if any("_fit" in name for name in needed) else ""
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + select.strip()


def oracle_sql() -> dict[str, str]:
    sources = (events, matches, features, players, pairs, tables)
    return {key: _with(sql) for source in sources for key, sql in source.QUERIES.items()}
