"""Set operations on tables and id lists (U family)."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; a column a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_first(key: list[str], *frames: DataFrame) -> DataFrame:
    """Union in which a key keeps the rows of the first frame that has it.

    Rows that repeat within a frame are reduced to the least one.
    """
    marked = union_all(*[f.withColumn("_from", F.lit(i)) for i, f in enumerate(frames)])
    rest = [c for c in marked.columns if c not in (*key, "_from")]
    best = marked.groupBy(*key).agg(F.min(F.struct("_from", *rest)).alias("_b"))
    return best.select(*key, *[F.col(f"_b.{c}").alias(c) for c in rest])


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both."""
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame, keep_copies: bool = False) -> DataFrame:
    """Rows of ``a`` that ``b`` lacks; copies are counted if ``keep_copies``."""
    return a.exceptAll(b) if keep_copies else a.subtract(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of exactly one side, with ``side`` left or right; one shuffle over both."""
    both = a.select("*", F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select("*", F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    sums = both.groupBy(*a.columns).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")).where("_a + _b = 1")
    return sums.select(*a.columns, F.when(F.col("_a") == 1, "left").otherwise("right").alias("side"))


def relation(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row about two sets of rows: ``n_left``, ``n_right``, ``n_common``, ``hamming``, ``jaccard``, ``equal``, ``disjoint``.

    Two empty sets are equal and disjoint, with a null Jaccard index.
    """
    both = a.select("*", F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select("*", F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    rows = both.groupBy(*a.columns).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    n = rows.agg(F.coalesce(F.sum("_a"), F.lit(0)).alias("n_left"), F.coalesce(F.sum("_b"), F.lit(0)).alias("n_right"), F.count_if(F.expr("_a + _b = 2")).alias("n_common"), F.count("*").alias("_all"))
    return n.select("n_left", "n_right", "n_common", (F.col("_all") - F.col("n_common")).alias("hamming"), F.try_divide("n_common", "_all").alias("jaccard"), (F.col("_all") == F.col("n_common")).alias("equal"), (F.col("n_common") == 0).alias("disjoint"))


def straddling(df: DataFrame, group: list[str], part: str) -> DataFrame:
    """Groups found in more than one part (leaks of a split): ``group``, ``n_parts``, sorted array ``parts``. Null groups are none."""
    known = reduce(lambda d, c: d.where(F.col(c).isNotNull()), group, df)
    return known.groupBy(*group).agg(F.countDistinct(part).alias("n_parts"), F.sort_array(F.collect_set(part)).alias("parts")).where("n_parts > 1")


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Jaccard index of two arrays as sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def subsets(members: list[str]) -> list[tuple[str, ...]]:
    """All non-empty subsets, small ones first."""
    return [c for k in range(1, len(members) + 1) for c in combinations(members, k)]


def explode_subsets(df: DataFrame, members: list[str], out: str = "subset") -> DataFrame:
    """Every row once per non-empty subset of ``members``, as an array of names; for a few members."""
    if len(members) > 12:
        raise ValueError("more than 4095 subsets")
    return df.withColumn(out, F.explode(F.array(*[F.array(*[F.lit(m) for m in s]) for s in subsets(members)])))
