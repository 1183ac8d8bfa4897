"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuetide.session import prepare

FLAGSHIP = "flagship_speech_quality"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its operator's number, with SQL for the same rows."""

    def add(function: Callable[[SparkSession, str], DataFrame]):
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(prepare(spark), sf_dir)

        _QUERIES[name] = prepared
        if sql:
            _ORACLES[name] = sql
        return function

    return add


def _load() -> None:
    from cuetide.plans import q_assets, q_attempts, q_intervals, q_joins, q_media, q_more, q_normalise, q_parts, q_ranking, q_runs, q_scalars, q_services, q_sources, q_streaming  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
