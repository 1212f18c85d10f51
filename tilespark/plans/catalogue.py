"""All core queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: puts a query into the catalogue, with its SQL where SQL can express it."""

    def put(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return put


def oracle_of(name: str) -> str:
    """A registered query's SQL, for one that builds on it."""
    return _ORACLES[name]


def _load() -> None:
    from tilespark.plans import blocks_q, experiments_q, neighbours_q, pictures_q, relational_q, residual_q, scene_q, search_q, sweeps_q, tiles_q, transforms_q  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
