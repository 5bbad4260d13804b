"""One value, computed once, in several places of an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value): the optimizer keeps the plan small and evaluates value once."""
    return F.transform(F.array(value), body)[0]
