"""Every query of the engine by name, with its SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions.groups import GROUPS
from .operators import coverage, evaluation, quality, relational, ticks
from .plans.dialect import duckdb_text, query
from .sources.frames import FRAMES, frame

SQL: dict[str, str] = {**relational.QUERIES, **ticks.QUERIES, **evaluation.QUERIES, **quality.QUERIES, **coverage.QUERIES}


def _group(name: str) -> Callable[[SparkSession, str], DataFrame]:
    group = GROUPS[name]
    return lambda spark, sf_dir: group.rounded(frame(spark, sf_dir, group.frame))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: query(text) for name, text in SQL.items()} | {name: _group(name) for name in GROUPS}
    from .operators import folds, store
    from .streaming import live

    return out | folds.QUERIES | store.QUERIES | live.QUERIES


def oracle_sql() -> dict[str, str]:
    from .operators import folds, store
    from .streaming import live

    return {name: duckdb_text(text) for name, text in SQL.items()} | {name: g.sql(FRAMES) for name, g in GROUPS.items()} | folds.SQL | store.SQL | live.SQL
