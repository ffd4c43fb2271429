"""Named queries over the driver's tables and their SQL."""

from __future__ import annotations

from . import entities, links


def queries() -> dict:
    return links.QUERIES | entities.QUERIES


def oracle_sql() -> dict[str, str]:
    return links.SQL | entities.SQL
