"""The named queries over the standard tables, and the SQL each is compared with.

Each module of this package registers its queries with :func:`corpusloom.plans.book.query`.
"""

from __future__ import annotations

from corpusloom.plans import feeds, gates, journal, ordered, quotes, registry, relations, scoring, search, sinks, stats, texts, vectors  # noqa: F401
from corpusloom.plans.book import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
