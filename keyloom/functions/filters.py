"""User-defined predicates and set-style updates as expressions."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def equals(column: str) -> Callable[[Any], Column]:
    """A table's filter: keeps rows whose column has the value. A null column keeps nothing."""
    return lambda value: F.col(column) == F.lit(value)


def set_by_key(key: str, values: dict, column: str) -> Column:
    """The column with new values for the given keys: a short list, part of the expression."""
    out = None
    for k, v in values.items():
        out = F.when(F.col(key) == k, F.lit(v)) if out is None else out.when(F.col(key) == k, F.lit(v))
    return out.otherwise(F.col(column)) if out is not None else F.col(column)


def arbitrary(predicate: Callable, *columns: str) -> Column:
    """A predicate over pandas columns, for what expressions can't say."""

    @F.pandas_udf("boolean")
    def keep(*values):
        return predicate(*values)

    return keep(*columns)
