"""Whole numbers out of text cells. A column with gaps is landed with a decimal point, so
``5.0`` is as good as ``5``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _decimal(c: Column) -> Column:
    return c.try_cast("decimal(38,6)")


def to_integer(c: Column) -> Column:
    """Number without its fraction, null for junk."""
    return F.coalesce(c.try_cast("bigint"), _decimal(c).try_cast("bigint"))


def whole(c: Column) -> Column:
    """Number that has no fraction, else null."""
    n = to_integer(c)
    return F.when(n == _decimal(c), n)
