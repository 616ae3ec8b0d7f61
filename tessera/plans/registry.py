"""Every registered query with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.graph import relation, table, with_relations

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


class Tables:
    """Base tables and derived relations of one data folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        from tessera.sources.graph import RELATIONS

        return relation(self.spark, self.sf_dir, name) if name in RELATIONS else table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None) -> Callable:
    """Registers ``f(tables) -> DataFrame`` under a name, with its SQL over base tables and derived relations."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[name] = with_relations(sql)
        return f

    return add


def _load() -> None:
    from tessera.plans import connections, graph, opinions, quality, streams, telemetry, temporal, text, writer  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
