"""Projections, filters and cell-wise cleaning (P family)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom.operators.aggregate import finite


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Old name -> new name, in this order; a column that is missing is an analysis error."""
    return df.select(*[F.col(f"`{a}`").alias(b) for a, b in columns.items()])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def select_numeric(df: DataFrame, keys: list[str], prefixes: tuple[str, ...] = (), include: tuple[str, ...] = ()) -> DataFrame:
    """``keys`` and the numeric columns whose name starts with any of ``prefixes`` and contains any of ``include`` (empty: all)."""
    names = [c for c in numeric_columns(df) if c not in keys and (not prefixes or c.startswith(prefixes)) and (not include or any(i in c for i in include))]
    return df.select(*keys, *names)


def drop_forbidden(df: DataFrame, keys: list[str], tokens: tuple[str, ...]) -> DataFrame:
    """``keys`` and the numeric columns whose lower-case name holds none of ``tokens`` (label leaks)."""
    return df.select(*keys, *[c for c in numeric_columns(df) if c not in keys and not any(t in c.lower() for t in tokens)])


def without_infinities(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN and infinities of the floating columns as nulls."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (columns is None or f.name in columns)]
    return df.withColumns({c: finite(c) for c in floating})


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which none of ``columns`` is null or NaN."""
    return df.dropna(subset=columns)


def band(value: Column | str, low: float, high: float, names: tuple[str, str, str] = ("LOW", "MEDIUM", "HIGH")) -> Column:
    """Below ``low``, from ``low`` to ``high`` (both included), above; null for a null, NaN is above."""
    v = _c(value)
    return F.when(v < low, names[0]).when(v <= high, names[1]).when(v > high, names[2])


def parse_flag(value: Column | str) -> Column:
    """Whether the trimmed lower-case text is ``true`` or ``1``; null is false."""
    return F.coalesce(F.lower(F.trim(_c(value).cast("string"))).isin("true", "1"), F.lit(False))


def parse_number(value: Column | str) -> Column:
    """The finite number a text stands for, else null."""
    return finite(F.trim(_c(value)).try_cast("double"))


def first_known(candidates: dict[str, Column], value: str = "value", origin: str = "origin") -> list[Column]:
    """The first non-null candidate in order, and its name."""
    which = None
    for name, c in candidates.items():
        which = F.when(c.isNotNull(), name) if which is None else which.when(c.isNotNull(), name)
    return [F.coalesce(*candidates.values()).alias(value), which.alias(origin)]


def mask_labels(df: DataFrame, labels: list[str], visible: Column) -> DataFrame:
    """``labels`` as null where ``visible`` isn't true."""
    return df.withColumns({c: F.when(visible, F.col(c)) for c in labels})


def safe_ratio(x: Column | str, total: Column | str) -> Column:
    """x / total where total > 0, else 0; null for a null x with a positive total."""
    return F.when(_c(total) > 0, F.try_divide(_c(x), _c(total))).otherwise(F.lit(0.0))


def fold_rare(df: DataFrame, column: str, train: Column, min_count: int, other: str = "__OTHER__", out: str | None = None) -> DataFrame:
    """Values with fewer than ``min_count`` rows in ``train`` become ``other``; nulls too.

    The kept values number at most train rows / ``min_count``; the planner broadcasts
    them only if its size estimate allows.
    """
    kept = df.where(train & F.col(column).isNotNull()).groupBy(F.col(column).alias("_kept")).count().where(F.col("count") >= min_count).select("_kept")
    joined = df.join(kept, df[column] == kept["_kept"], "left")
    return joined.withColumn(out or column, F.coalesce("_kept", F.lit(other))).drop("_kept")
