"""All queries and their SQL. The subpackage ``llm`` is added if it can be imported."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathom.plans import corpus, dealt, payloads, series, units

MODULES = [dealt, series, corpus, payloads, units]


def _all() -> list:
    try:
        more = [importlib.import_module("fathom.llm.queries")]
    except ModuleNotFoundError as e:
        if not (e.name or "").startswith("fathom.llm"):
            raise
        more = []
    return [*MODULES, *more]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _all() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _all() for k, s in getattr(m, "SQL", {}).items()}
