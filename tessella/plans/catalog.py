"""The engine's registered queries, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from tessella.plans import flows, registry, reports, rules, scans, sequences  # noqa: F401  (registering)

FLAGSHIP = "change_points"


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
