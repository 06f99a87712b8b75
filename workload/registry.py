"""Queries by name, with the SQL each one has to agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.views import Workspace, in_duckdb, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, select: str | None = None, ctes: str = ""):
    """Register a function of a ``Workspace`` as a query, with its SQL if there is one."""
    def register(function: Callable[[Workspace], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function(Workspace(spark, sf_dir))
        if select is not None:
            ORACLES[name] = in_duckdb(with_views(select, ctes, "materialized "))
        return function

    return register
