"""Registered queries: each area module maps a query name to a Spark callable and,
where SQL can say the same, to an oracle statement over the same tables."""

from __future__ import annotations

from importlib import import_module

AREAS = (
    "low_stats", "chat_stats", "standardize", "stats_query", "mapping", "catalog", "lineage", "recipe",
    "sources", "round_trip", "dedup", "adhoc_sql",
)


def registry() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for area in AREAS:
        module = import_module(f"millrace.plans.{area}")
        overlap = queries.keys() & module.QUERIES.keys()
        if overlap:
            raise ValueError(f"query names registered twice: {sorted(overlap)}")
        queries.update(module.QUERIES)
        oracles.update(module.ORACLES)
    return queries, oracles
