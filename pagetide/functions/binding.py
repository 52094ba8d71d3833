"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` evaluated once, however often `use` mentions it.

    Without it, expressions that mention their operand several times grow exponentially when
    nested. Python UDFs may occur in `value`, not in what `use` returns.
    """
    return F.element_at(F.transform(F.array(value), use), 1)
