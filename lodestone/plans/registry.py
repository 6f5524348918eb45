"""All queries of the core and their SQL equivalents, by name."""

from __future__ import annotations

from . import descriptive, histories, keyed, people, scalar, small, state

MODULES = (descriptive, scalar, histories, people, state, small, keyed)


def queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
