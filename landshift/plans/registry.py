"""All registered queries and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ("risk_queries", "catalogue_queries", "raster_queries", "imagery_queries", "case_queries")


def load() -> tuple[dict, dict[str, str]]:
    queries: dict = {}
    oracle: dict[str, str] = {}
    for name in MODULES:
        module = importlib.import_module(f"landshift.plans.{name}")
        queries.update(module.QUERIES)
        oracle.update(module.ORACLE)
    return queries, oracle
