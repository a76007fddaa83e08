"""SQL text with named parameters over the node and edge tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession


def query(spark: SparkSession, text: str, tables: dict[str, DataFrame], **params: Any) -> DataFrame:
    """Run ``text``; ``{name}`` stands for a table and ``:name`` for a parameter."""
    return spark.sql(text, args=params or None, **tables)
