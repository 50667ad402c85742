"""All queries and their SQL."""

from vigilake.plans import bodies, conversations, evaluation, receipts, roundtrips, traces
from vigilake.plans.base import Query

PARTS = (evaluation, receipts, traces, conversations, bodies, roundtrips)


def all_queries() -> dict[str, Query]:
    return {name: fn for part in PARTS for name, fn in part.CATALOG.queries.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.CATALOG.sql.items()}
