"""Queries over the given tables, each with its SQL: what the operators do, bound to events, orders and the rest."""

from __future__ import annotations

from chronopanel.queries import aggregates, evaluations, explanations, expressions, joins, metrics, models, panels, protocols, rules, severity, sources
from chronopanel.queries.base import REGISTRY, SQL

MODULES = (panels, expressions, severity, joins, aggregates, protocols, metrics, evaluations, rules, explanations, models, sources)


def queries() -> dict:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
