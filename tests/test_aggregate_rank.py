import math

import pytest
from pyspark.sql import functions as F

from chainloom.operators import aggregate as A
from chainloom.operators import rank as R
from chainloom.operators.prefix import quantiles, value_ranks

NAN = float("nan")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_quantiles_interpolate_and_skip_nulls(spark):
    d = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", 7.0), ("b", None), (None, 1.0)], "g string, v double")
    got = {r.g: r.q for r in quantiles(d, ["g"], "v", [0.0, 0.5, 0.9]).collect()}
    assert got == {"a": [1.0, 2.5, pytest.approx(3.7)], "b": [7.0] * 3, None: [1.0] * 3}


def test_value_ranks_of_ties_and_weights(spark):
    d = spark.createDataFrame([(1.0, 1), (1.0, 0), (2.0, 1), (5.0, None)], "v double, w long")
    assert rows(value_ranks(d, [], "v", weights=("w",)).select("v", "n", "before", "total", "w", "before_w", "total_w"), "v") == [(1.0, 2, 0, 4, 1, 0, 2), (2.0, 1, 2, 4, 1, 1, 2), (5.0, 1, 3, 4, 0, 2, 2)]
    assert value_ranks(d.limit(0), [], "v").count() == 0


def test_toy_statistics(spark):
    d = spark.createDataFrame([("x", float(v)) for v in (-2, -1, 0, 1, 2, 3)] + [("zero", 0.0), ("none", None), ("none", NAN), ("inf", math.inf)], "g string, v double")
    got = {r.g: r for r in A.top_stats(d, ["g"], "v", 5).collect()}
    assert got["x"].positive_mean == 1.0 and got["x"].top_mean == 1.0 and got["x"].top_share == 1.0
    assert got["zero"].top_share == 0.0 and got["none"].top_share is None and got["none"].n == 0 and got["inf"].max is None


def test_numeric_summary_of_an_empty_table(spark):
    d = spark.createDataFrame([], "v double")
    r = A.numeric_summary(d, ["v"]).collect()
    assert r == []
    one = A.numeric_summary(spark.createDataFrame([(None,), (NAN,)], "v double"), ["v"]).first()
    assert (one.n, one.missing, one.missing_fraction, one["mean"]) == (0, 2, 1.0, None)


def test_consensus_tie_and_short_texts(spark):
    d = spark.createDataFrame([("g", "AC"), ("g", "BC"), ("g", "B"), ("g", "A"), ("g", ""), ("g", None)], "g string, t string")
    assert rows(A.consensus(d, ["g"], "t"), "g") == [("g", "AC", 4)]


def test_weighted_mean_guards(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 4.0), ("a", None, 9.0), ("z", 0.0, 5.0)], "g string, w double, v double")
    assert rows(d.groupBy("g").agg(A.weighted_mean("w", "v").alias("m")), "g") == [("a", 3.5), ("z", None)]


def test_rank_bins_differ_from_ntile(spark):
    d = spark.createDataFrame([(i, float(i)) for i in range(10)], "k long, v double")
    assert [r.bin for r in R.rank_bins(d, [], "v", "k", 4).orderBy("k").collect()] == [0, 0, 0, 1, 1, 2, 2, 2, 3, 3]


def test_ranks_of_ties_and_nulls(spark):
    d = spark.createDataFrame([("a", 0.3), ("b", 0.1), ("c", 0.3), ("d", 0.2), ("e", None)], "k string, v double")
    assert rows(R.dense_rank(d, [], "v").select("k", "rank"), "k") == [("a", 3), ("b", 1), ("c", 3), ("d", 2), ("e", None)]
    assert rows(R.average_rank(d, [], "v").select("k", "rank"), "k") == [("a", 3.5), ("b", 1.0), ("c", 3.5), ("d", 2.0), ("e", None)]
    assert rows(R.min_rank(d, [], "v").select("k", "rank"), "k") == [("a", 3), ("b", 1), ("c", 3), ("d", 2), ("e", 5)]


def test_gaussian_ranks_are_symmetric(spark):
    d = spark.createDataFrame([(i, float(i)) for i in range(5)], "k long, v double")
    z = [r.z for r in R.rank_to_gaussian(d, [], "v").orderBy("k").collect()]
    assert z[2] == pytest.approx(0, abs=1e-9) and z[0] == pytest.approx(-z[4]) and z[4] == pytest.approx(1.2815515655446004)


def test_diverse_top_fills_up(spark):
    d = spark.createDataFrame([("m1", "r1", 1.0), ("m2", "r1", 1.1), ("m3", "r2", 2.0)], "m string, r string, s double")
    assert [r.m for r in R.diverse_top(d, "r", [F.asc("s"), F.asc("m")], 3).orderBy("place").collect()] == ["m1", "m3", "m2"]


def test_argmin_ties_go_where_told(spark):
    d = spark.createDataFrame([("g", 0.5, 1.0), ("g", 0.5, 10.0), ("g", None, 99.0)], "g string, s double, a double")
    assert R.argmin_grid(d, ["g"], "s", "a").first().a == 10.0 and R.argmin_grid(d, ["g"], "s", "a", larger=False).first().a == 1.0


def test_shuffled_input_gives_the_same_ranks(spark):
    d = spark.range(500).select("id", (F.col("id") * 37 % 101).cast("double").alias("v"))
    a = rows(R.average_rank(d.repartition(1), [], "v"), "id")
    assert a == rows(R.average_rank(d.orderBy(F.xxhash64("id")).repartition(7), [], "v"), "id")
