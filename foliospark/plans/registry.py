"""All queries of the engine's own operators, by name."""

from __future__ import annotations


def _modules():
    from foliospark.plans import contours, decoding, dictionaries, evaluation, pages, pixels, regions

    return decoding, regions, pixels, contours, pages, dictionaries, evaluation


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _modules() for name, sql in m.ORACLE_SQL.items()}
