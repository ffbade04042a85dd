"""The queries of the core operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.plans import articles, facts, nested, pools, postprocess, scores, sources, streams, topics

_MODULES = (nested, topics, articles, scores, facts, streams, pools, postprocess, sources)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.registry.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.registry.sql.items()}
