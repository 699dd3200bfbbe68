"""All registered queries and their oracle SQL, merged from the plan modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = (
    "crease.plans.cricket_queries",
    "crease.plans.ingest_queries",
    "crease.plans.eval_queries",
    "crease.plans.grading_queries",
    "crease.plans.dataset_queries",
    "crease.plans.run_queries",
    "crease.plans.file_queries",
)


def _load():
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}
    for name in _MODULES:
        mod = importlib.import_module(name)
        for key, fn in mod.QUERIES.items():
            if key in queries:
                raise ValueError(f"duplicate query name {key}")
            queries[key] = fn
        oracles.update(getattr(mod, "ORACLES", {}))
    return queries, oracles


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _load()[0]


def all_oracles() -> dict[str, str]:
    q, o = _load()
    return {k: v for k, v in o.items() if k in q}
