"""Queries over the shared test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        REGISTRY[name] = Query(fn, sql)
        return fn
    return add


def load_all() -> dict[str, Query]:
    from hydrospark.registry import (  # noqa: F401
        forecast, gauges, hazards, history, index, series, sources, spatial, streams, tracks,
    )
    return REGISTRY
