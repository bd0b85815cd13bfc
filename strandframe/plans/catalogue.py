"""All registered queries of the library's own operators."""

from __future__ import annotations

from strandframe.plans import aggregates, expression, flows, functions, joins, orders, projections, scans, statistics, trees  # noqa: F401
from strandframe.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
