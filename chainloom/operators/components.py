"""Connected components by alternating star contraction.

Every round sends each edge to its smaller end point's minimum (large star) and then to
its larger end point's minimum (small star). The number of rounds grows with the
logarithm of the longest path, no vertex list is ever gathered and minima are combined
before the shuffle. The minima are shuffled anew for the joins, so that adaptive
execution can split the edges of a hot vertex: it leaves joins alone whose other side
is still partitioned by its aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.session import stage, unstage


def _seal(edges: DataFrame, label: str) -> tuple[DataFrame, tuple]:
    kept = stage(edges, label)
    row = kept.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return kept, (row.n, row.h)


def _reshuffled(low: DataFrame) -> DataFrame:
    """``u`` under an expression that equals it, as ``m`` <= ``u``, but hides from the planner how the rows lie."""
    return low.select(F.greatest("u", "m").alias("u"), "m")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Label the vertices of ``edges`` with the smallest vertex of their component.

    Returns ``node``, ``component``; a vertex without an edge to another vertex doesn't
    appear. Null end points, loops and repeated edges are ignored; an empty edge table
    gives an empty result. Extra columns are dropped.
    """
    x, y = F.col(a), F.col(b)
    current, mark = _seal(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges"
    )
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _reshuffled(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _reshuffled(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct()
        )
        new, new_mark = _seal(small, "stars")
        unstage(current)
        done, current, mark = new_mark == mark, new, new_mark
        if done:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
