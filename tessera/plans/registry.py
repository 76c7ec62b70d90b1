"""Collects the registered queries of the relational and duplicate-review packs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with the SQL that must give the same rows where SQL can express it."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def merkle_sql(rows: str, group: list[str]) -> str:
    """SQL for (group..., hash, rows) of verify.merkle over rows, SQL that gives group... and the text t, at its own depth.

    Five levels stand for tables of up to 256 * 16^4 rows; levels below the table's depth leave everything as it is.
    """
    keys = "".join(f"{g}, " for g in group)
    level = f"""SELECT {keys}substr(h, 1, depth) AS node, depth, md5(string_agg(h || ':' || n, chr(10) ORDER BY h || ':' || n)) AS d, SUM(n) AS n
      FROM (SELECT {keys}md5(t) AS h, COUNT(*) AS n FROM source GROUP BY ALL), (SELECT CAST(greatest(0, ceil(log2(greatest(COUNT(*), 1) / 256.0) / 4)) AS INTEGER) AS depth FROM source) GROUP BY ALL"""
    for k in (3, 2, 1, 0):
        level = f"""SELECT {keys}CASE WHEN {k} < depth THEN substr(node, 1, {k}) ELSE node END AS node, depth,
          CASE WHEN {k} < depth THEN md5(string_agg(node || ':' || d, chr(10) ORDER BY node || ':' || d)) ELSE any_value(d) END AS d, SUM(n) AS n FROM ({level}) GROUP BY {keys}CASE WHEN {k} < depth THEN substr(node, 1, {k}) ELSE node END, depth"""
    return f"WITH source AS ({rows}) SELECT {keys}d AS hash, CAST(n AS BIGINT) AS rows FROM ({level})"


def _load() -> None:
    from tessera.plans import files, filesystem, more, relational, similarity, workflow  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
