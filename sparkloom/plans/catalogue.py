"""All queries of the core and their SQL twins."""

from __future__ import annotations

from sparkloom.plans import analysis, converted, corpus, custom, exchange, imported, ordered, scored  # noqa: F401
from sparkloom.plans.registry import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
