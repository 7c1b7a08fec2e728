"""A value that an expression names more than once, computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``; the plan holds ``value`` once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)
