"""Naming a value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body names it.

    Expressions inside lambda bodies are outside common-subexpression elimination; a bound variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
