"""All registered queries of the archive's operators."""

from __future__ import annotations

from fieldmark.queries import archives, catalog, recordings, tables  # noqa: F401  they register themselves
from fieldmark.queries.fixtures import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
