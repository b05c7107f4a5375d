"""Every query of the library by name, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = fn
        if oracle:
            _oracle[name] = oracle
        return fn

    return keep


def twin(name: str) -> str:
    """The SQL of a query that is registered already, as a part of another twin."""
    return _oracle[name]


def queries() -> dict[str, Query]:
    load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_oracle)


def load() -> None:
    """Import the modules that register queries."""
    from . import audit_queries, core_queries, crawl_queries, report_queries, site_queries  # noqa: F401
    from . import issue_queries, more_queries, shop, stream_queries  # noqa: F401
