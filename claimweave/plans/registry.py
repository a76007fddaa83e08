"""Registered queries: a name, a plan over the views, and where SQL can say the same, the
SQL text. Column names and types agree between the two."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.plans.views import Views, views, with_views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    def add(plan: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = with_views(sql, *uses)
        return plan

    return add


def bind(name: str) -> Callable[[SparkSession, str], DataFrame]:
    plan = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(views(spark, sf_dir))

    run.__name__ = name
    return run


def score(name: str) -> Column:
    return F.round(name, 6).alias(name)


def stamp(name: str) -> Column:
    """Times are compared as text."""
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def joined(name: str) -> Column:
    return F.array_join(name, "|").alias(name)
