"""A named group of queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Part:
    """Collects queries: ``@part.query(sql)`` registers a function under its own name."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable] = {}
        self.ORACLE: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        def register(f: Callable) -> Callable:
            if f.__name__ in self.QUERIES:
                raise ValueError(f"{f.__name__} is registered twice")
            self.QUERIES[f.__name__] = f
            if sql:
                self.ORACLE[f.__name__] = sql
            return f

        return register


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero, so that two engines print the same number."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)
