"""Error measures, correlations and distances of distributions (X family).

Ranks and cumulative distributions come from :func:`chainloom.operators.prefix.value_ranks`,
so a group of any size is spread over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.operators.aggregate import finite, unpivoted
from chainloom.operators.prefix import quantiles, value_ranks

TINY = 1e-12


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pearson(a: Column | str, b: Column | str, least: int = 2) -> Column:
    """Aggregate: Pearson correlation over rows with both values; null under ``least`` rows or where a side's sd is below 1e-12."""
    a, b = _c(a), _c(b)
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a).cast("double"), F.when(both, b).cast("double")
    fine = (F.count(x) >= least) & (F.stddev_pop(x) >= TINY) & (F.stddev_pop(y) >= TINY)
    return F.when(fine, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def mae(y: Column | str, p: Column | str) -> Column:
    return F.avg(F.abs(_c(y) - _c(p)))


def regression_metrics(y: Column | str, p: Column | str) -> list[Column]:
    """Aggregates ``n``, ``mae``, ``rmse``, ``bias``, ``r2``, ``pearson``, ``slope``, ``intercept`` and ``ccc`` over rows with both values.

    ``r2`` is null where y doesn't vary; where p doesn't, ``slope`` is null and
    ``intercept`` the mean of y; ``ccc`` is Lin's concordance (sample moments).
    """
    y, p = _c(y), _c(p)
    both = y.isNotNull() & p.isNotNull()
    y, p = F.when(both, y), F.when(both, p)
    e = p - y
    flat = F.stddev_pop(p) <= TINY
    cov, vy, vp = F.covar_samp(y, p), F.var_samp(y), F.var_samp(p)
    return [
        F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        F.when(F.stddev_pop(y) >= TINY, 1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"), pearson(y, p).alias("pearson"),
        F.when(~flat, F.try_divide(F.covar_pop(y, p), F.var_pop(p))).alias("slope"),
        F.when(flat, F.avg(y)).otherwise(F.avg(y) - F.try_divide(F.covar_pop(y, p), F.var_pop(p)) * F.avg(p)).alias("intercept"),
        F.try_divide(2 * cov, vy + vp + (F.avg(y) - F.avg(p)) * (F.avg(y) - F.avg(p))).alias("ccc"),
    ]


def ranked_pairs(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Rows with both values, with average ranks ``ra`` and ``rb`` in the group."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    for c, out in ((a, "ra"), (b, "rb")):
        r = value_ranks(rows, by, c).select(*[F.col(x).alias(f"_k{i}") for i, x in enumerate(by)], F.col(c).alias("_kv"), (F.col("before") + (F.col("n") + 1) / 2).alias(out))
        same = reduce(lambda s, i: s & F.col(by[i]).eqNullSafe(F.col(f"_k{i}")), range(len(by)), F.col(c) == F.col("_kv"))
        rows = rows.join(r, same).drop("_kv", *[f"_k{i}" for i in range(len(by))])
    return rows


def spearman(df: DataFrame, by: list[str], a: str, b: str, least: int = 2) -> DataFrame:
    """Per group ``n`` and ``spearman`` (Pearson of average ranks), guarded as :func:`pearson`."""
    return ranked_pairs(df, by, a, b).groupBy(*by).agg(F.count("*").alias("n"), pearson("ra", "rb", least).alias("spearman"))


def kendall(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Kendall's tau-b per group: ``n``, ``tau``; null where a side is constant.

    Pairs of rows of one group are formed, so it is meant for groups of score tables
    (models, recipes), not of raw rows; equal pairs of values are counted first.
    """
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count("*").alias("_n"))
    left = cells.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(a).alias("_a"), F.col(b).alias("_b"), F.col("_n").alias("_m"))
    same = reduce(lambda s, i: s & F.col(by[i]).eqNullSafe(F.col(f"_k{i}")), range(len(by)), F.lit(True))
    sign = F.signum(F.col(a) - F.col("_a")) * F.signum(F.col(b) - F.col("_b"))
    w = F.col("_n") * F.col("_m")
    pairs = cells.join(left, same).groupBy(*by).agg(F.sum(sign * w).alias("_s"))  # each pair twice
    n = cells.groupBy(*by).agg(F.sum("_n").alias("n"))

    def tied(c: str, out: str) -> DataFrame:
        return cells.groupBy(*by, c).agg(F.sum("_n").alias("_n")).groupBy(*by).agg(F.sum(F.col("_n") * (F.col("_n") - 1)).alias(out))

    out = n
    for part in (pairs, tied(a, "_ta"), tied(b, "_tb")):
        named = part.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(by)})
        out = out.join(named, same).select(*out.columns, *[c for c in part.columns if c not in by])
    all_ = F.col("n") * (F.col("n") - 1)
    return out.select(*by, "n", F.try_divide(F.col("_s"), F.sqrt((all_ - F.col("_ta")).cast("double") * (all_ - F.col("_tb")))).alias("tau"))


def auc(df: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """``n_pos``, ``n_neg``, ``auc`` (ties half) and ``average_precision`` per group; null without both classes.

    ``average_precision`` sums precision times gain in recall over the distinct scores, greatest first.
    """
    d = df.withColumn("_p", F.coalesce(positive, F.lit(False)).cast("long"))
    r = value_ranks(d, by, score, weights=("_p",))
    below = F.col("before") - F.col("before__p")
    here = F.col("n") - F.col("_p")
    at = F.col("total__p") - F.col("before__p")  # positives with this score or more
    rows = F.col("total") - F.col("before")
    return r.groupBy(*by).agg(
        F.max("total__p").alias("n_pos"), (F.max("total") - F.max("total__p")).alias("n_neg"),
        F.try_divide(F.sum(F.col("_p") * (below + here / 2)), F.max("total__p").cast("double") * (F.max("total") - F.max("total__p"))).alias("auc"),
        F.try_divide(F.sum(F.col("_p") * F.try_divide(at, rows)), F.max("total__p")).alias("average_precision"),
    )


def recall_at(df: DataFrame, by: list[str], score: str, key: str, positive: Column, k: int) -> DataFrame:
    """Share of the positives among the ``k`` greatest scores (ties by ``key``), per group."""
    from pyspark.sql import Window

    d = df.withColumn("_p", F.coalesce(positive, F.lit(False)).cast("long"))
    total = d.groupBy(*by).agg(F.sum("_p").alias("n_pos"))
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(key))
    top = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy(*by).agg(F.sum("_p").alias("_hit"))
    return top.join(total, by).select(*by, "n_pos", F.try_divide("_hit", "n_pos").alias("recall"))


def correlation_table(df: DataFrame, target: str, columns: list[str], least: int = 10) -> DataFrame:
    """Per ``feature``: ``n`` complete pairs, ``pearson``, ``spearman`` with the target; features under ``least`` pairs are left out."""
    long = unpivoted(df.withColumn("_y", finite(F.col(target).cast("double"))), ["_y"], columns).where("_y is not null and value is not null")
    both = ranked_pairs(long, ["feature"], "_y", "value")
    out = both.groupBy("feature").agg(F.count("*").alias("n"), pearson("_y", "value").alias("pearson"), pearson("ra", "rb").alias("spearman"))
    return out.where(F.col("n") >= least)


def correlation_matrix(df: DataFrame, key: list[str], member: str, value: str) -> DataFrame:
    """Pearson correlation of all pairs of members (a < b) over shared keys: ``a``, ``b``, ``n``, ``pearson``; null if one is constant."""
    from chainloom.operators.joins import group_pairs

    return group_pairs(df, key, member, value).groupBy("a", "b").agg(F.count("*").alias("n"), pearson("value_a", "value_b").alias("pearson"))


def moments_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of all pairs of columns in one pass over the wide table: ``a``, ``b``, ``pearson``."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[pearson(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("pearson")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def redundancy_clusters(pairs: list[tuple[str, str, float]], order: list[str], threshold: float = 0.98) -> dict[str, str]:
    """Greedy: in ``order``, the first feature without a cluster seeds one and takes all free features with \\|rho\\| >= ``threshold`` to it.

    On the driver, over pairs of columns of a table, not of rows.
    """
    near: dict[str, set[str]] = {}
    for a, b, r in pairs:
        if r is not None and abs(r) >= threshold:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    seed: dict[str, str] = {}
    for f in order:
        if f not in seed:
            for g in (f, *near.get(f, ())):
                seed.setdefault(g, f)
    return {f: seed[f] for f in order}


def cdf_distances(df: DataFrame, by: list[str], value: str, in_a: Column) -> DataFrame:
    """Exact distances of the two samples a (``in_a``) and b (the rest) per group: ``n_a``, ``n_b``, ``wasserstein``, ``ks``.

    Sum of \\|F - G\\| times the gap to the next value, and the greatest \\|F - G\\|; null where
    a sample is empty. Rows whose ``in_a`` is null don't count.
    """
    from pyspark.sql import Window

    d = df.where(in_a.isNotNull()).withColumn("_a", in_a.cast("long"))
    r = value_ranks(d, by, value, weights=("_a",))
    fa = F.try_divide(F.col("before__a") + F.col("_a"), F.col("total__a"))
    nb = F.col("total") - F.col("total__a")
    fb = F.try_divide(F.col("before") + F.col("n") - F.col("before__a") - F.col("_a"), nb)
    # the next value is the one with `before` = before + n of this one, an equi-join instead of a window over the group
    nxt = r.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("before").alias("_kb"), F.col(value).alias("_next"))
    same = reduce(lambda s, i: s & F.col(by[i]).eqNullSafe(F.col(f"_k{i}")), range(len(by)), F.col("before") + F.col("n") == F.col("_kb"))
    gap = r.join(nxt, same, "left").withColumn("_d", F.abs(fa - fb))
    return gap.groupBy(*by).agg(
        F.max("total__a").alias("n_a"), (F.max("total") - F.max("total__a")).alias("n_b"),
        F.when(F.max("_d").isNotNull(), F.coalesce(F.sum(F.col("_d") * (F.col("_next") - F.col(value))), F.lit(0.0))).alias("wasserstein"), F.max("_d").alias("ks"),
    )


def quantile_distance(df: DataFrame, by: list[str], value: str, in_a: Column, points: int = 50) -> DataFrame:
    """Mean absolute difference of the two samples' quantiles on an even grid from 0 to 1: ``distance``."""
    probs = [i / (points - 1) for i in range(points)]
    d = df.withColumn("_side", in_a)
    q = quantiles(d.where("_side is not null"), [*by, "_side"], value, probs)
    side = lambda flag: F.max(F.when(F.col("_side") == flag, F.col("q")))
    wide = q.groupBy(*by).agg(side(True).alias("_qa"), side(False).alias("_qb"))
    gaps = F.zip_with("_qa", "_qb", lambda a, b: F.abs(a - b))
    return wide.select(*by, (F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / points).alias("distance"))


def category_balance(df: DataFrame, category: str, in_a: Column, in_b: Column, eps: float = 1e-12) -> DataFrame:
    """One row on the category shares of two samples: ``js`` (Jensen-Shannon divergence, nats), ``tv``, ``l1``, ``bin_l1`` (of counts).

    Shares over the union of categories; null categories are one; null where a sample is empty.
    """
    a, b = F.coalesce(in_a, F.lit(False)), F.coalesce(in_b, F.lit(False))
    counts = df.groupBy(category).agg(F.count_if(a).alias("a"), F.count_if(b).alias("b")).where("a + b > 0")
    total = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    t = counts.crossJoin(F.broadcast(total))  # one row
    p, q = F.try_divide("a", "na"), F.try_divide("b", "nb")
    pc, qc = F.greatest(p, F.lit(eps)), F.greatest(q, F.lit(eps))
    m = (pc + qc) / 2
    return t.agg(
        F.sum(pc * F.ln(pc / m) / 2 + qc * F.ln(qc / m) / 2).alias("js"), (F.sum(F.abs(p - q)) / 2).alias("tv"), F.sum(F.abs(p - q)).alias("l1"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("bin_l1")
    )


def standardised_difference(value: Column | str, in_a: Column, in_b: Column) -> Column:
    """Aggregate: \\|mean a - mean b\\| over the pooled sd (population) + 1e-12; 0 where a sample has under two values."""
    v = _c(value)
    a, b = F.when(in_a, v), F.when(in_b, v)
    pooled = F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2) + TINY
    return F.when((F.count(a) >= 2) & (F.count(b) >= 2), F.abs(F.avg(a) - F.avg(b)) / pooled).otherwise(F.lit(0.0))


def quantile_imbalance(df: DataFrame, value: str, train: Column, other: Column, probs: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """One row ``imbalance``: mean absolute difference of the quantiles of two samples over the sd of all; 1.0 where a sample is empty or nothing varies."""
    d = df.select(F.col(value).alias("_v"), F.when(train, "a").when(other, "b").alias("_side")).where("_v is not null and _side is not null")
    sd = df.agg(F.stddev_pop(value).alias("_sd"))
    q = quantiles(d, ["_side"], "_v", list(probs)).agg(F.max(F.when(F.col("_side") == "a", F.col("q"))).alias("_a"), F.max(F.when(F.col("_side") == "b", F.col("q"))).alias("_b"))
    gap = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / len(probs)
    return q.crossJoin(sd).select(F.when(F.col("_a").isNull() | F.col("_b").isNull() | (F.coalesce("_sd", F.lit(0.0)) < TINY), F.lit(1.0)).otherwise(F.try_divide(gap, F.col("_sd"))).alias("imbalance"))  # one row each


def split_score(df: DataFrame, role: str, train: str, others: list[str], value: str, category: str, group: str, weights: dict[str, float], hard: float = 100.0) -> DataFrame:
    """Penalty of a split, one row: ``leaks``, per other role ``<role>_imbalance``, ``<role>_tv``, ``<role>_smd``, ``score``.

    ``leaks``: groups in more than one role. The score is ``hard`` for each leak and for
    each empty role, plus the ``weights`` (imbalance, tv, smd) of the terms, lower is better.
    """
    from chainloom.operators.sets import straddling

    d = df.where(F.col(role).isNotNull())
    out = straddling(d, [group], role).agg(F.count("*").alias("leaks"))
    score = F.lit(float(hard)) * F.col("leaks")
    for r in others:
        inside, base = F.col(role) == r, F.col(role) == train
        q = quantile_imbalance(d, value, base, inside).withColumnRenamed("imbalance", f"{r}_imbalance")
        c = category_balance(d, category, base, inside).select(F.col("tv").alias(f"{r}_tv"))
        m = d.agg(standardised_difference(value, base, inside).alias(f"{r}_smd"), F.count_if(inside).alias(f"_n_{r}"))
        out = out.crossJoin(q).crossJoin(c).crossJoin(m)  # one row each
        score = score + sum((F.lit(float(weights.get(t, 0.0))) * F.coalesce(F.col(f"{r}_{t}"), F.lit(1.0)) for t in ("imbalance", "tv", "smd")), F.lit(0.0)) + F.when(F.col(f"_n_{r}") == 0, F.lit(float(hard))).otherwise(0.0)
    return out.select("leaks", *[f"{r}_{t}" for r in others for t in ("imbalance", "tv", "smd")], score.alias("score"))


def energy_distance(df: DataFrame, by: list[str], x: str, y: str, in_a: Column) -> DataFrame:
    """2 E|X-Y| - E|X-X'| - E|Y-Y'| of two 2-D samples per group, self pairs included: ``n_a``, ``n_b``, ``energy``.

    Inherently all pairs of a group, so it is meant for the small samples of split audits; equal points are counted first.
    """
    cells = df.where(in_a.isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y"), in_a.alias("_s")).agg(F.count("*").alias("_n"))
    other = cells.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_x").alias("_x2"), F.col("_y").alias("_y2"), F.col("_s").alias("_s2"), F.col("_n").alias("_n2"))
    same = reduce(lambda s, i: s & F.col(by[i]).eqNullSafe(F.col(f"_k{i}")), range(len(by)), F.lit(True))
    d = F.sqrt((F.col("_x") - F.col("_x2")) ** 2 + (F.col("_y") - F.col("_y2")) ** 2) * F.col("_n") * F.col("_n2")
    kind = F.col("_s").cast("int") + F.col("_s2").cast("int")
    sums = cells.join(other, same).groupBy(*by).agg(*[F.sum(F.when(kind == k, d)).alias(f"_d{k}") for k in (0, 1, 2)])
    n = cells.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("_s"), F.col("_n"))), F.lit(0)).alias("n_a"), F.coalesce(F.sum(F.when(~F.col("_s"), F.col("_n"))), F.lit(0)).alias("n_b"))
    out = n.join(sums.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(by)}), same)
    mean = lambda k, a, b: F.try_divide(F.col(f"_d{k}"), F.col(a).cast("double") * F.col(b))
    # cross pairs are summed in both directions, so mean(1) already is 2 E|X-Y|
    return out.select(*by, "n_a", "n_b", (mean(1, "n_a", "n_b") - mean(2, "n_a", "n_a") - mean(0, "n_b", "n_b")).alias("energy"))


def robustness(df: DataFrame, keys: list[str], member: str, columns: list[str], key: str, k: int = 20) -> DataFrame:
    """Agreement of every feature between every two members: ``feature``, ``a``, ``b``, ``n``, ``pearson``, ``spearman``, ``median_gap``, ``p95_gap``, ``top_jaccard``, ``bottom_jaccard``, ``verdict``.

    The Jaccard indices are those of the ``k`` greatest and least keys; the verdict is
    ROBUST (spearman >= 0.8), MODERATE (>= 0.5) or FRAGILE.
    """
    from pyspark.sql import Window

    from chainloom.operators.joins import group_pairs
    from chainloom.operators.sets import jaccard

    long = unpivoted(df, [*keys, member], columns).where("value is not null")
    pairs = group_pairs(long, [*keys, "feature"], member, "value").withColumn("_gap", F.abs(F.col("value_a") - F.col("value_b")))
    by = ["feature", "a", "b"]
    ranks = ranked_pairs(pairs, by, "value_a", "value_b")
    base = ranks.groupBy(*by).agg(F.count("*").alias("n"), pearson("value_a", "value_b").alias("pearson"), pearson("ra", "rb").alias("spearman"))
    gaps = quantiles(pairs, by, "_gap", [0.5, 0.95])
    w = lambda c, down: Window.partitionBy(*by).orderBy(F.desc(c) if down else F.asc(c), F.asc(key))
    marked = pairs.select(*by, key, *[(F.row_number().over(w(c, down)) <= k).alias(n) for c, down, n in (("value_a", True, "_ta"), ("value_b", True, "_tb"), ("value_a", False, "_ba"), ("value_b", False, "_bb"))])
    sets = marked.groupBy(*by).agg(*[F.collect_set(F.when(F.col(n), F.col(key))).alias(n) for n in ("_ta", "_tb", "_ba", "_bb")])  # k keys at most
    verdict = F.when(F.col("spearman") >= 0.8, "ROBUST").when(F.col("spearman") >= 0.5, "MODERATE").otherwise("FRAGILE")
    return base.join(gaps, by).join(sets, by).select(
        *by, "n", "pearson", "spearman", F.col("q")[0].alias("median_gap"), F.col("q")[1].alias("p95_gap"), jaccard("_ta", "_tb").alias("top_jaccard"), jaccard("_ba", "_bb").alias("bottom_jaccard"), verdict.alias("verdict")
    )


def principal_angles(a, b):
    """Squared cosines of the principal angles of two subspaces spanned by columns (NumPy arrays on the driver), greatest first."""
    import numpy as np

    qa, _ = np.linalg.qr(np.asarray(a, float))
    qb, _ = np.linalg.qr(np.asarray(b, float))
    return np.clip(np.linalg.svd(qa.T @ qb, compute_uv=False), 0.0, 1.0) ** 2
