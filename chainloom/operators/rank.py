"""Ranks, bins, best rows and top-k (W and T families)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from chainloom.operators.prefix import quantiles, value_ranks

__all__ = ["average_rank", "min_rank", "dense_rank", "rank_to_uniform", "rank_to_gaussian", "rank_bins", "quantile_bins", "best_rows", "first_rows", "last_rows", "fraction_of_total", "rotation", "round_robin", "prefix_choice", "lagged", "rolling", "top_n", "diverse_top", "argmin_grid"]


def _ranked(df: DataFrame, by: list[str], value: str, rank: Column, out: str) -> DataFrame:
    ranks = value_ranks(df, by, value).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(value).alias("_kv"), rank.alias(out))
    same = F.col(value) == F.col("_kv")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return df.join(ranks, same, "left").select(*df.columns, out)


def average_rank(df: DataFrame, by: list[str], value: str, out: str = "rank") -> DataFrame:
    """Rank from 1 in the group, ties averaged; null values have no rank."""
    return _ranked(df, by, value, F.col("before") + (F.col("n") + 1) / 2, out)


def min_rank(df: DataFrame, by: list[str], value: str, out: str = "rank") -> DataFrame:
    """Rank from 1, ties take the least; nulls share the last rank."""
    total = df.groupBy(*by).agg((F.count(value) + 1).alias("_last"))
    ranked = _ranked(df, by, value, F.col("before") + 1, "_r")
    last = total.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_last")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return ranked.join(last, same).select(*df.columns, F.coalesce("_r", "_last").alias(out))


def dense_rank(df: DataFrame, by: list[str], value: str, out: str = "rank") -> DataFrame:
    """Rank from 1 without gaps: the number of different values up to this one; nulls have none."""
    distinct = df.select(*by, value).where(F.col(value).isNotNull()).distinct()
    return _ranked(distinct, by, value, F.col("before") + 1, out).transform(lambda r: df.join(r.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate([*by, value])}), _null_safe([*by, value]), "left").select(*df.columns, out))


def _null_safe(cols: list[str]) -> Column:
    same = F.lit(True)
    for i, c in enumerate(cols):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return same


def rank_to_uniform(df: DataFrame, by: list[str], value: str, out: str = "u") -> DataFrame:
    """(average rank - 0.5) / n in the group."""
    return _ranked(df, by, value, (F.col("before") + (F.col("n") + 1) / 2 - 0.5) / F.col("total"), out)


def normal_quantile(p: pd.Series) -> pd.Series:
    """Inverse of the standard normal distribution by bisection on ``erfc`` with Newton steps, good to 1e-13."""
    import numpy as np

    erfc = np.frompyfunc(math.erfc, 1, 1)
    q = p.to_numpy(np.float64)
    out = np.full(len(q), np.nan)
    ok = (q > 0) & (q < 1)
    lo, hi = np.full(ok.sum(), -39.0), np.full(ok.sum(), 39.0)
    for _ in range(70):
        mid = (lo + hi) / 2
        low = 0.5 * erfc(-mid / math.sqrt(2)).astype(np.float64) < q[ok]
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    out[ok] = (lo + hi) / 2
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def _ppf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield normal_quantile(s)


def rank_to_gaussian(df: DataFrame, by: list[str], value: str, out: str = "z", clip: float = 1e-6) -> DataFrame:
    """Normal quantile of :func:`rank_to_uniform`, clipped to ``clip`` .. 1 - ``clip``.

    The quantile is taken once for each distinct value, not once a row.
    """
    u = F.least(F.greatest((F.col("before") + (F.col("n") + 1) / 2 - 0.5) / F.col("total"), F.lit(clip)), F.lit(1 - clip))
    return _ranked(df, by, value, _ppf(u), out)


def rank_bins(df: DataFrame, by: list[str], value: str, key: str, bins: int, out: str = "bin") -> DataFrame:
    """``min(bins - 1, int(rank * bins / n))`` with ranks from 0 in the order of ``value``, then ``key``; not ``ntile``."""
    # a tie is broken by key, so the pair is ranked: it is unique where key is
    ranks = value_ranks(df, by, value, key)
    named = ranks.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, value, key])], F.least(F.lit(bins - 1), F.floor(F.col("before") * bins / F.col("total"))).cast("int").alias(out))
    return df.join(named, _null_safe([*by, value, key]), "left").select(*df.columns, out)


def quantile_bins(df: DataFrame, by: list[str], value: str, bins: int, out: str = "bin") -> DataFrame:
    """Bins between quantile edges, right-closed, the least value in the first; equal edges are one edge. Null for null values."""
    edges = quantiles(df, by, value, [i / bins for i in range(bins + 1)], "_e").withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(by)}).withColumn("_e", F.array_distinct("_e"))
    inner = F.size(F.filter(F.slice("_e", 2, F.greatest(F.size("_e") - 2, F.lit(0))), lambda e: F.col(value) > e))
    joined = df.join(edges, _null_safe(by), "left")  # as many edges as groups
    return joined.select(*df.columns, F.when(F.col(value).isNotNull() & F.col("_e").isNotNull(), inner).alias(out))


def best_rows(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in ``order``, which should be total; the whole row, also its nulls.

    Spark keeps one row a group before the shuffle (window group limit), so hot groups are cheap.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_rows(df: DataFrame, by: list[str], position: str, *tie: str) -> DataFrame:
    """The row with the least ``position`` of each group (dedup, keep first)."""
    return best_rows(df, by, [F.col(position).asc_nulls_last(), *[F.col(t).asc_nulls_last() for t in tie]])


def last_rows(df: DataFrame, by: list[str], position: str, *tie: str) -> DataFrame:
    """The row with the greatest ``position`` of each group (dedup, keep last)."""
    return best_rows(df, by, [F.col(position).desc_nulls_last(), *[F.col(t).desc_nulls_last() for t in tie]])


def fraction_of_total(counts: DataFrame, by: list[str], n: str = "n", out: str = "fraction") -> DataFrame:
    """``n`` over its sum in the group; ``counts`` is an aggregated table."""
    total = F.sum(n).over(Window.partitionBy(*by))
    return counts.withColumn(out, F.when(total > 0, F.col(n) / total).otherwise(F.lit(0.0)))


def rotation(df: DataFrame, fold: str = "fold", folds: int = 5) -> DataFrame:
    """Every row once per ``rotation`` k: ``part`` TEST for fold k, VAL for fold k+1, TRAIN else; null folds are left out."""
    k = df.where(F.col(fold).isNotNull()).withColumn("rotation", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    step = F.pmod(F.col(fold) - F.col("rotation"), F.lit(folds))
    return k.withColumn("part", F.when(step == 0, "TEST").when(step == 1, "VAL").otherwise("TRAIN"))


def round_robin(df: DataFrame, value: str, key: str, folds: int, out: str = "fold") -> DataFrame:
    """Row i in the order of ``value``, then ``key``, gets fold i mod ``folds``."""
    ranks = value_ranks(df, [], value, key)
    named = ranks.select(F.col(value).alias("_k0"), F.col(key).alias("_k1"), F.pmod("before", F.lit(folds)).cast("int").alias(out))
    return df.join(named, _null_safe([value, key]), "left").select(*df.columns, out)


def prefix_choice(df: DataFrame, by: list[str], step: str, score: str, outcome: str) -> DataFrame:
    """Per group and ``step``: the ``chosen`` outcome (that of the least ``score`` so far, ties to the earliest) and its running minimum ``best_so_far``.

    Groups are trajectories of bounded length.
    """
    run = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    chosen = df.withColumn("chosen", F.min_by(outcome, F.struct(F.col(score), F.col(step))).over(run))
    return chosen.withColumn("best_so_far", F.min("chosen").over(run))


def lagged(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Add ``previous``, ``following`` and ``change`` of ``value`` within the group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({"previous": F.lag(value).over(w), "following": F.lead(value).over(w)}).withColumn("change", F.col(value) - F.col("previous"))


def rolling(df: DataFrame, by: list[str], order: list[str], value: str, rows: int) -> DataFrame:
    """Add ``rolling_mean`` over this and the ``rows`` - 1 rows before, and ``running_sum``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({"rolling_mean": F.avg(value).over(w.rowsBetween(1 - rows, 0)), "running_sum": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))})


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in ``order``; each task keeps ``n`` rows."""
    return df.orderBy(*order).limit(n)


def diverse_top(df: DataFrame, kind: str, order: list[Column], n: int) -> DataFrame:
    """``n`` rows with ``place``: first the best of each ``kind``, best first, then the best of the rest."""
    w = Window.partitionBy(kind).orderBy(*order)
    turn = df.withColumn("_again", (F.row_number().over(w) > 1).cast("int"))
    # at most n rows of either round can be chosen
    few = turn.orderBy("_again", *order).limit(n)
    return few.withColumn("place", F.row_number().over(Window.partitionBy().orderBy("_again", *order))).drop("_again")


def argmin_grid(df: DataFrame, by: list[str], score: str, parameter: str, larger: bool = True, digits: int = 15) -> DataFrame:
    """The grid row with the least ``score``; scores equal to ``digits`` decimals tie, to the larger (or smaller) ``parameter``."""
    tie = F.col(parameter).desc() if larger else F.col(parameter).asc()
    return best_rows(df.where(F.col(score).isNotNull()), by, [F.round(score, digits), tie])
