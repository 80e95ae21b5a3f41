import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.operators import blends as B
from chainloom.operators import folds as K
from chainloom.operators import linear as M
from chainloom.operators import nested as C
from chainloom.operators import spatial as G
from chainloom.operators import stats as X
from chainloom.operators.components import connected_components


def points(spark, seed=1, n=120, groups=3):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(groups)), *map(float, rng.normal(size=3)), float(rng.normal())) for i in range(n)]
    return spark.createDataFrame(rows, "k long, g int, x double, y double, z double, w double"), rows


def test_range_join_equals_brute_force(spark):
    d, rows = points(spark)
    got = {(r.key_a, r.key_b) for r in G.range_pairs(d, d, ["g"], "k", 0.7).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and sum((p - q) ** 2 for p, q in zip(a[2:5], b[2:5])) <= 0.49}
    assert got == want
    plan = G.range_pairs(d, d, ["g"], "k", 0.7)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_neighbourhood_toy(spark):
    d = spark.createDataFrame([(0, 0.0, 1.0), (1, 3.0, 0.25), (2, 20.0, 0.0), (3, None, 5.0)], "k long, x double, w double").withColumns({"g": F.lit(1), "y": F.lit(0.0), "z": F.lit(0.0)})
    assert {r.k: r.total for r in G.neighbour_sums(d, ["g"], "k", F.col("w"), 5.0).collect()} == {0: 1.25, 1: 1.25, 2: 0.0, 3: None}


def test_components_of_a_star_a_path_and_loops(spark):
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(300)}, **{1000 + i: 1000 for i in range(61)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_superposition_ignores_rotation(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(20, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    assert G.kabsch(a, a @ q + 5) == pytest.approx(0, abs=1e-6)
    assert G.kabsch(a, a * [1, 1, -1]) > 0.1


def test_similar_texts_equal_brute_force(spark):
    from chainloom.functions.text import positional_identity

    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ABC"), rng.integers(1, 20))) for _ in range(60)]
    texts += [t[:-1] + "C" for t in texts[:30]] + texts[:3] + ["", None]
    d = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    for threshold in (0.5, 0.8, 0.9):
        got = {(r.a, r.b) for r in G.similar_texts(d, "k", "t", threshold).collect()}
        o = d.select(F.col("k").alias("k2"), F.col("t").alias("t2"))
        want = {(r.k, r.k2) for r in d.crossJoin(o).where((F.col("k") < F.col("k2")) & (F.length("t") > 0) & (F.length("t2") > 0) & (positional_identity("t", "t2") >= threshold)).collect()}
        assert got == want


def table(spark, n=200, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = x @ [1.0, -2.0, 0.0] + rng.normal(size=n) * 0.1 + 3
    rows = [(i, i % 5, *map(float, x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "k long, fold int, a double, b double, c double, y double"), x, y


def test_ridge_equals_the_normal_equations(spark):
    d, x, y = table(spark)
    m = M.total(M.moments(d, ["a", "b", "c", "y"]))
    model = M.ridge(m, ["a", "b", "c"], 7.0)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 7 * np.eye(3), z.T @ (y - y.mean())) / x.std(0)
    assert np.allclose(model.coef, w) and model.intercept == pytest.approx(y.mean() - w @ x.mean(0))


def test_wide_and_narrow_sums_agree(spark):
    d, x, _ = table(spark)
    wide = d.select("fold", *[F.col("abc"[i % 3]).alias(f"c{i}") for i in range(14)])
    m = M.moments(wide, [f"c{i}" for i in range(14)], "fold")
    n = M.moments(d, ["a", "b", "c"], "fold")
    assert all(np.allclose(m[k].g[:3, :3], n[k].g) and np.allclose(m[k].s[:3], n[k].s) and m[k].n == n[k].n for k in range(5))


def test_lasso_drops_the_idle_column_and_raises_if_cut_short(spark):
    d, _, _ = table(spark)
    m = M.total(M.moments(d, ["a", "b", "c", "y"]))
    assert M.elastic_net(m, ["a", "b", "c"], 0.2).coef[2] == 0.0
    with pytest.raises(RuntimeError, match="no convergence"):
        M.elastic_net(m, ["a", "b", "c"], 0.001, most_rounds=1)


def test_rotation_is_the_same_for_shuffled_rows(spark):
    d, _, _ = table(spark)
    score = lambda f: M.rotation_oof(f, ["a", "b", "c"], "y", "fold", [0.1, 1.0, 10.0])[0].agg(F.avg(F.abs(F.col("y") - F.col("oof")))).first()[0]
    assert score(d) == pytest.approx(score(d.orderBy(F.xxhash64("k")).repartition(7)), abs=1e-9)


def test_block_oof_with_all_axes_is_plain_ridge(spark):
    d, _, _ = table(spark)
    full = C.block_oof(d, {"x": ["a", "b", "c"]}, "y", "fold", 0.0, most=3, forced=True).orderBy("k").select("oof").collect()
    plain = C.plain_oof(d, ["a", "b", "c"], "y", "fold", 0.0).orderBy("k").select("oof").collect()
    assert np.allclose([r.oof for r in full], [r.oof for r in plain])


def test_pls_with_all_components_is_least_squares(spark):
    d, _, _ = table(spark)
    m = M.total(M.moments(d, ["a", "b", "c", "y"]))
    assert np.allclose(C.pls(m, ["a", "b", "c"], 3).coef, M.ridge(m, ["a", "b", "c"], 0.0).coef, atol=1e-6)


def test_nnls_keeps_weights_non_negative():
    a = np.array([[1.0, 0.2], [0.2, 1.0], [0.5, 0.1]])
    w = B.nnls(a.T @ a, a.T @ np.array([1.0, -1.0, 0.5]))
    assert (w >= 0).all() and w[1] == 0 and w[0] > 0


def test_blends_fail_on_a_missing_member(spark):
    d = spark.createDataFrame([(1, "A", 1.0), (1, "B", 3.0), (2, "A", 2.0), (2, "B", float("nan"))], "k int, m string, p double")
    assert B.blend(d.where("k = 1"), ["k"], "m", "p", ["A", "B"]).first().blend == 2.0
    with pytest.raises(Exception, match="a member has no prediction"):
        B.blend(d, ["k"], "m", "p", ["A", "B"]).collect()


def test_level_fill_equals_one_by_one():
    rng = np.random.default_rng(0)
    for _ in range(300):
        loads = rng.integers(0, 20, 4).tolist()
        size, n = int(rng.integers(1, 6)), int(rng.integers(0, 30))
        plain = loads[:]
        got = [0] * 4
        for _ in range(n):
            f = plain.index(min(plain))
            plain[f] += size
            got[f] += 1
        assert K.level_fill(loads, size, n) == got


def test_bootstrap_weights_are_the_same_as_the_expression(spark):
    d = spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    got = {(r.g, r.replicate): r.v for r in K.bootstrap_means(d, ["g"], "k", {"v": F.col("v")}, 4, seed=2).collect()}
    reps = d.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("w", K.poisson_weight(K.mix("k", F.col("r") + 2 * 1_000_003)))
    want = {(r.g, r.r): r.m for r in reps.groupBy("g", "r").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m")).collect()}
    assert got == pytest.approx(want)


def test_correlation_guards(spark):
    d = spark.createDataFrame([("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("one", 1.0, 1.0), ("ok", 1.0, 2.0), ("ok", 2.0, 4.0), ("ok", None, 4.0)], "g string, a double, b double")
    assert {r.g: r.r for r in d.groupBy("g").agg(X.pearson("a", "b").alias("r")).collect()} == {"flat": None, "one": None, "ok": pytest.approx(1.0)}


def test_distances_of_equal_and_empty_samples(spark):
    d = spark.createDataFrame([("same", 1.0, True), ("same", 1.0, False), ("empty", 1.0, True), ("apart", 0.0, True), ("apart", 2.0, False)], "g string, v double, a boolean")
    got = {r.g: (r.wasserstein, r.ks) for r in X.cdf_distances(d, ["g"], "v", F.col("a")).collect()}
    assert got == {"same": (0.0, 0.0), "empty": (None, None), "apart": (2.0, 1.0)}


def test_a_common_beginning_makes_no_candidates(spark):
    d = spark.createDataFrame([(i, f"Supplier#{i:09}") for i in range(1000)], "k long, t string")
    assert G.similar_texts(d, "k", "t", 0.9).count() == 1000 * 27 // 2
    met = G._met_by_groups(d.select(F.col("t").alias("_t")), 18, 0.9)
    assert met.count() < 30_000  # of 499,500 pairs
