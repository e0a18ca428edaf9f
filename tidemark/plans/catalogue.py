"""All registered queries and their SQL twins."""

from __future__ import annotations

from tidemark.plans import account_queries, learning_queries, metric_queries, model_queries, record_queries, text_queries  # noqa: F401
from tidemark.plans.register import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
