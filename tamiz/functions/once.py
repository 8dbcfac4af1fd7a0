"""A value that is computed once for a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once for a row: used within a lambda, a plain column's definition may be put
    in its place by the optimizer and computed for every element."""
    return F.transform(F.array(value), then)[0]
