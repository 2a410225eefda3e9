"""All queries of the library by name, with their DuckDB SQL where it can express them."""

from __future__ import annotations

from . import content, engines, insight, reports, upkeep

ALL = [reports, content, insight, engines, upkeep]


def queries() -> dict:
    return {k: v for m in ALL for k, v in m.plans.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in ALL for k, v in m.plans.sql.items()}
