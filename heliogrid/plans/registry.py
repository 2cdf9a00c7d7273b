"""Names of the queries, what runs them, and the same results in SQL."""

from __future__ import annotations

from .adapters import ctes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "M01_smart_persistence_metrics"


def query(sql: str | None = None, needs: tuple[str, ...] = ()):
    """Registers a function (spark, sf_dir) under its name; needs are adapter tables that sql reads."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            more = sql.lstrip()
            head = ctes(*needs)
            if not head:
                ORACLES[f.__name__] = more
            elif more.upper().startswith("WITH "):
                ORACLES[f.__name__] = f"WITH {head}, {more[5:]}"
            else:
                ORACLES[f.__name__] = f"WITH {head} {more}"
        return f

    return put

