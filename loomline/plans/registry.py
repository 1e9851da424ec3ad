"""All queries over the driver's tables and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytic, extended, relational
from .derived import DERIVED
from .dialect import duck, spark_query

_SHARED = relational.SHARED | analytic.SHARED | extended.SHARED
_DERIVED = DERIVED | extended.DERIVED
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: spark_query(text) for name, text in _SHARED.items()}
SQL: dict[str, str] = {name: duck(text) for name, text in _SHARED.items()}
QUERIES |= extended.NATIVE
QUERIES |= {name: run for name, (run, _) in _DERIVED.items()}
SQL |= {name: text for name, (_, text) in _DERIVED.items() if text}
