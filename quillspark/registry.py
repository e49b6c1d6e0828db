"""Where queries register themselves, with their DuckDB SQL."""

from __future__ import annotations

from .plans import binding as B

AS_OF, AS_OF_DAY = 1_706_745_600_000, "2024-01-31"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True, name: str | None = None):
    """Register a function of (session, folder) under its name, or the given one, with its SQL over the views."""

    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = f"WITH {B.DUCK.strip()}{'' if sql.startswith(',') else chr(10)}{sql}" if views else sql
        return f

    return register
