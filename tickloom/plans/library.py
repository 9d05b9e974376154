"""All queries of the library."""

from __future__ import annotations

from . import queries_logs, queries_market, queries_reports, queries_ticks  # noqa: F401
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
