"""Registered queries: each runs an operator over the driver's tables, with an equal SQL text where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import measured_joins
from .adapters import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` as a query; ``oracle`` is SQL over the tables and the named views."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            measured_joins(spark)
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(views.split(), oracle)
        return fn

    return register
