"""Where queries over the star-schema graph are registered, with their SQL twins."""

from __future__ import annotations

from .stargraph import SQL, Star

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, families: bool = True):
    """Register a query under its function's name; its SQL may use the families of stargraph.SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Star(spark, folder))
        if sql:
            with_ = sql.strip()
            if families:
                with_ = f"WITH {SQL.strip()}" + (f", {with_[5:]}" if with_.upper().startswith("WITH ") else f" {with_}")
            ORACLE[f.__name__] = with_
        return f

    return add
