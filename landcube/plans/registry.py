"""All registered queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import roles

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, role: str, oracle: str | None = None, extra: str = ""):
    """Register ``f(rows)`` over a role. ``oracle`` selects from ``r``, the role's
    rows; ``extra`` holds further common tables."""

    def add(f):
        Q[name] = lambda spark, sf_dir: f(roles.frame(spark, sf_dir, role))
        if oracle is not None:
            SQL[name] = f"with recursive r as ({roles.duck(role)}){', ' + extra if extra else ''} {oracle}"
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["agg_02_seasonal_composite"](spark, sf_dir)


def _load() -> None:
    from . import balance, images, jobs, maps, samples, surface, workflow  # noqa: F401  each registers its queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return Q


def oracles() -> dict[str, str]:
    _load()
    return SQL
