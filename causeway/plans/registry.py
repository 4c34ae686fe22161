"""The registered queries of the library's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from causeway.plans.views import SQL, Views

_QUERIES: dict[str, tuple[Callable[[Views], DataFrame], str | None]] = {}


def uniform_sql(*key: str, seed: int = 0) -> str:
    """functions.uniform() in SQL; keys are expressions without nulls."""
    text = " || '|' || ".join([*(f"CAST({k} AS VARCHAR)" for k in key), f"'{seed}'"])
    return f"((CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) + 0.5) / {float(1 << 52)!r})"


def normal_sql(*key: str, seed: int = 0) -> str:
    """functions.normal() in SQL."""
    return f"(sqrt(-2 * ln({uniform_sql(*key, seed=2 * seed)})) * cos(2 * pi() * {uniform_sql(*key, seed=2 * seed + 1)}))"


def query(name: str, sql: str | None = None, views: str = ""):
    """Registers a function of Views as a query; sql is its equivalent over the named views."""

    def put(function: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        text = None if sql is None else "WITH " * bool(views) + ", ".join(f"{v} AS ({SQL[v]})" for v in views.split()) + " " + sql.strip()
        if text and views and sql.strip().upper().startswith("WITH "):
            head = "WITH RECURSIVE " if sql.strip().upper().startswith("WITH RECURSIVE ") else "WITH "
            text = head + ", ".join(f"{v} AS ({SQL[v]})" for v in views.split()) + ", " + sql.strip()[len(head) :]
        _QUERIES[name] = (function, text)
        return function

    return put


def _load() -> None:
    from causeway.plans import aggregates, cleaning, files, forecasts, graphs, lookups, priors, seasons, series, statements  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query; each takes (spark, sf_dir)."""
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL with the same rows."""
    _load()
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
