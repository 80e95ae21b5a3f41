"""Scores of a prediction by segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainloom.session import read


def _corr(a: str, b: str) -> Column:
    """Pearson correlation; null under two rows or where a side has a standard deviation below 1e-12."""
    varies = (F.count("*") >= 2) & (F.stddev_pop(a) >= 1e-12) & (F.stddev_pop(b) >= 1e-12)
    return F.when(varies, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def _ranked(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the average rank of ``column`` in its segment, as ``r<column>``; only distinct values are ordered."""
    values = df.groupBy("segment", column).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("segment").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    ranks = values.select("segment", column, (F.sum("_n").over(upto) - (F.col("_n") - 1) / 2).alias(f"r{column}"))
    return df.join(ranks, ["segment", column])


def segment_scores(scored: DataFrame) -> DataFrame:
    """Per ``segment``: ``n``, ``mae``, ``rmse``, ``bias`` (mean of p - y), ``r2``, ``pearson``, ``spearman``, rounded to 6 decimals.

    ``scored``: ``segment``, truth ``y``, prediction ``p``. Rows whose ``y`` or ``p`` is
    no finite number, or without segment, don't count. ``r2`` is null if ``y`` doesn't vary.
    """
    rows = scored.where("segment is not null and abs(y) < double('infinity') and abs(p) < double('infinity')").select("segment", "y", "p")
    error = F.col("p") - F.col("y")
    r2 = F.when(F.stddev_pop("y") >= 1e-12, 1 - F.try_divide(F.avg(error * error), F.var_pop("y")))
    out = {"mae": F.avg(F.abs(error)), "rmse": F.sqrt(F.avg(error * error)), "bias": F.avg(error), "r2": r2, "pearson": _corr("y", "p"), "spearman": _corr("ry", "rp")}
    return _ranked(_ranked(rows, "y"), "p").groupBy("segment").agg(F.count("*").alias("n"), *[(F.round(c, 6) + F.lit(0.0)).alias(k) for k, c in out.items()])


def score_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extended price against quantity times retail price, by return flag."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    lines = read(spark, sf_dir, "lineitem").join(part, "l_partkey")
    return segment_scores(lines.select(F.col("l_returnflag").alias("segment"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.col("p_retailprice")).alias("p")))


QUERIES = {"score_by_segment": score_by_segment}
ORACLE = {
    "score_by_segment": """with rows as (select l_returnflag segment, l_extendedprice y, l_quantity * p_retailprice p from lineitem join part on l_partkey = p_partkey),
known as (select * from rows where segment is not null and isfinite(y) and isfinite(p)),
ranked as (select *, rank() over (partition by segment order by y) + (count(*) over (partition by segment, y) - 1) / 2.0 ry,
  rank() over (partition by segment order by p) + (count(*) over (partition by segment, p) - 1) / 2.0 rp from known)
select segment, count(*) as n, round(avg(abs(p - y)), 6) as mae, round(sqrt(avg((p - y) * (p - y))), 6) as rmse, round(avg(p - y), 6) as bias,
  round(case when stddev_pop(y) >= 1e-12 then 1 - avg((p - y) * (p - y)) / var_pop(y) end, 6) as r2,
  round(case when count(*) >= 2 and stddev_pop(y) >= 1e-12 and stddev_pop(p) >= 1e-12 then covar_pop(y, p) / (stddev_pop(y) * stddev_pop(p)) end, 6) as pearson,
  round(case when count(*) >= 2 and stddev_pop(ry) >= 1e-12 and stddev_pop(rp) >= 1e-12 then covar_pop(ry, rp) / (stddev_pop(ry) * stddev_pop(rp)) end, 6) as spearman
from ranked group by segment"""
}
