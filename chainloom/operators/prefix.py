"""Running totals, ranks and quantiles within groups of any size, without one task per group.

Rows are cut into buckets, by leading bits of a hash or by ranges of the value; the
buckets' totals are summed up first (a small table), and only inside a bucket a window
runs. A group that holds a third of all rows is spread over all buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainloom.session import stage


def order_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A non-negative 63-bit hash to order rows by."""
    return F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def _same(by: list[str]) -> Column:
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return same


def prefix_sum(df: DataFrame, by: list[str], order: str, tie: list[str], value: str, out: str, bits: int = 10) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``by`` that come before this one.

    The order is ``order`` (from :func:`order_hash`), then ``tie``, which should make it
    total. Null values count as 0; a null group is a group. Empty input stays empty.
    """
    cut = df.withColumn("_bucket", F.shiftright(F.col(order), 63 - bits))
    totals = cut.groupBy(*by, "_bucket").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_total"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_bucket").alias("_kb"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, -1)
    near = cut.withColumn("_near", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = near.join(base, (F.col("_bucket") == F.col("_kb")) & _same(by))
    return joined.select(*df.columns, (F.col("_base") + F.col("_near")).alias(out))


def value_ranks(df: DataFrame, by: list[str], *values: str, weights: tuple[str, ...] = ()) -> DataFrame:
    """One row for each distinct value of a group: ``by``, ``values``, ``n``, ``before``, ``total``.

    ``n`` rows have this value (a tuple where several ``values`` are given), ``before``
    rows of the group have a smaller one, ``total`` rows have any. For each column w of
    ``weights`` also ``w`` (its sum at this value), ``before_w`` and ``total_w``.

    Rows with a null in ``values`` don't count; NaN is the greatest number; a null group
    is a group; null weights count as 0. Values are cut into ranges over all groups, so a
    hot group lies in many parts and a hot value is a single row.
    """
    known = df
    for v in values:
        known = known.where(F.col(v).isNotNull())
    sums = [F.coalesce(F.sum(w), F.lit(0)).alias(w) for w in weights]
    counted = known.groupBy(*by, *values).agg(F.count("*").alias("n"), *sums)
    ranged = stage(counted.repartitionByRange(*[F.col(c) for c in (*by, *values)]).withColumn("_part", F.spark_partition_id()), "ranged")
    measures = ["n", *weights]
    totals = ranged.groupBy(*by, "_part").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    run = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    base = totals.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)],
        F.col("_part").alias("_kp"),
        *[F.coalesce(F.sum(f"_t_{m}").over(run), F.lit(0)).alias(f"_base_{m}") for m in measures],
        *[F.sum(f"_t_{m}").over(whole).alias(f"_all_{m}") for m in measures],
    )
    inside = Window.partitionBy(*by, "_part").orderBy(*values).rowsBetween(Window.unboundedPreceding, -1)
    near = ranged.select("*", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_near_{m}") for m in measures])
    joined = near.join(base, (F.col("_part") == F.col("_kp")) & _same(by))
    named = {m: ("before", "total") if m == "n" else (f"before_{m}", f"total_{m}") for m in measures}
    return joined.select(
        *by, *values, *measures,
        *[c for m in measures for c in ((F.col(f"_base_{m}") + F.col(f"_near_{m}")).alias(named[m][0]), F.col(f"_all_{m}").alias(named[m][1]))],
    )


def with_average_rank(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the average rank (from 1) of ``value`` in its group as ``out``; null for a null value."""
    ranks = value_ranks(df, by, value).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(value).alias("_kv"), (F.col("before") + (F.col("n") + 1) / 2).alias(out))
    return df.join(ranks, (F.col(value) == F.col("_kv")) & _same(by), "left").select(*df.columns, out)


def quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], out: str = "q") -> DataFrame:
    """Exact quantiles with linear interpolation per group: ``by``, array ``out``.

    The distributed counterpart of ``percentile``, which keeps a group's values in one
    task. Nulls don't count; a group without a value doesn't appear.
    """
    ranks = value_ranks(df, by, value)
    picked = []
    for p in probs:
        at = (F.col("total") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        here = [F.max(F.when((i >= F.col("before")) & (i < F.col("before") + F.col("n")), F.col(value))) for i in (low, high)]
        share = F.max(at - low)
        picked.append(here[0] + (here[1] - here[0]) * share)
    return ranks.groupBy(*by).agg(F.array(*picked).alias(out))
