"""Collects the queries of a module and their SQL."""

from __future__ import annotations

from collections.abc import Callable


def collector() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """``QUERIES, SQL`` and the decorator ``query(sql)`` that fills them under the function's name."""
    queries, sqls = {}, {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return add

    return queries, sqls, query
