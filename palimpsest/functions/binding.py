"""Naming the value of an expression inside another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once, however often f names it.

    A column named twice is planned and, where Spark interprets it, worked out twice.
    """
    return F.element_at(F.transform(F.array(value), f), 1)
