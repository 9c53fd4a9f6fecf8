"""Help with higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once; inside a lambda it would be computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
