"""Ensembles of predictions and score tables (E family)."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainloom.operators.linear import Linear, Moments, moments, ridge, total
from chainloom.operators.prefix import with_average_rank
from chainloom.operators.rank import best_rows
from chainloom.operators.stats import kendall, pearson, spearman


def blend(df: DataFrame, keys: list[str], member: str, value: str, members: list[str], how: str = "mean") -> DataFrame:
    """Mean or median of exactly the given members for each key: ``keys``, ``blend``. A key that lacks a member fails the query."""
    rows = df.where(F.col(member).isin(members)).groupBy(*keys).agg(
        F.count_distinct(F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(member))).alias("_n"), (F.avg(value) if how == "mean" else F.median(value)).alias("_v")
    )
    checked = F.when(F.col("_n") == len(members), F.col("_v")).otherwise(F.raise_error(F.lit("a member has no prediction")).cast("double"))
    return rows.select(*keys, checked.alias("blend"))


def rank_mean(df: DataFrame, keys: list[str], member: str, value: str) -> DataFrame:
    """Mean over members of the average rank of the value among the member's predictions: ``keys``, ``n``, ``rank_mean``."""
    ranked = with_average_rank(df.where(F.col(value).isNotNull()), [member], value, "_r")
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_r").alias("rank_mean"))


def simplex(members: int, steps: int) -> list[tuple[float, ...]]:
    """All weights in multiples of 1 / ``steps`` that sum to 1."""
    out = []
    for cuts in combinations(range(steps + members - 1), members - 1):
        edges = (-1, *cuts, steps + members - 1)
        out.append(tuple((b - a - 1) / steps for a, b in zip(edges, edges[1:])))
    return out


def convex_weights(df: DataFrame, columns: list[str], y: str, steps: int = 20) -> DataFrame:
    """Weights on the simplex with the least MAE, ties to the lexicographically least: one row ``weights``, ``mae``.

    The grid is exploded next to the rows and summed before anything moves.
    """
    grid = F.explode(F.array(*[F.array(*[F.lit(float(w)) for w in ws]) for ws in simplex(len(columns), steps)])).alias("weights")
    rows = df.where(F.col(y).isNotNull())
    for c in columns:
        rows = rows.where(F.col(c).isNotNull())
    p = F.lit(0.0)
    for i, c in enumerate(columns):
        p = p + F.col("weights")[i] * F.col(c)
    scored = rows.select(y, *columns, grid).groupBy("weights").agg(F.avg(F.abs(F.col(y) - p)).alias("mae"))
    return scored.orderBy(F.round("mae", 12), "weights").limit(1)


def nnls(g: np.ndarray, b: np.ndarray, rounds: int = 10_000) -> np.ndarray:
    """Non-negative least squares from the normal equations (active set)."""
    n = len(b)
    w, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        slope = b - g @ w
        slope[free] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= 1e-10 * max(1.0, np.abs(b).max()):
            break
        free[j] = True
        while True:
            trial = np.zeros(n)
            trial[free] = np.linalg.lstsq(g[np.ix_(free, free)], b[free], rcond=None)[0]
            if (trial[free] > 0).all():
                w = trial
                break
            bad = free & (trial <= 0)
            step = (w[bad] / (w[bad] - trial[bad])).min()
            w = w + step * (trial - w)
            free &= w > 1e-14
            w[~free] = 0.0
    return w


def stack_weights(m: Moments, columns: list[str], method: str, alpha: float = 1.0) -> Linear:
    """Stacker from the sums of the members' out-of-fold predictions and y (last): ``nnls`` (weights scaled to sum 1), ``ridge`` or ``mean``."""
    if method == "mean":
        return Linear(columns, np.full(len(columns), 1 / len(columns)), 0.0)
    if method == "ridge":
        return ridge(m, columns, alpha)
    w = nnls(m.g[:-1, :-1], m.g[:-1, -1])
    return Linear(columns, w / w.sum() if w.sum() > 0 else np.full(len(columns), 1 / len(columns)), 0.0)


def stacked_oof(df: DataFrame, columns: list[str], y: str, fold: str, method: str, folds: int, alpha: float = 1.0) -> DataFrame:
    """``df`` with ``stack``: the stacker fitted on the other folds (nested, never on the rows it scores)."""
    if method == "median":
        return df.withColumn("stack", F.when(F.col(fold).isNotNull(), _median(columns)))
    parts = moments(df, [*columns, y], fold)
    out = None
    for k in range(folds):
        p = stack_weights(total(parts, (k,)), columns, method, alpha).predict()
        out = F.when(F.col(fold) == k, p) if out is None else out.when(F.col(fold) == k, p)
    return df.withColumn("stack", out)


def _median(columns: list[str]) -> Column:
    s = F.sort_array(F.array(*columns))
    n = len(columns)
    return s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2


def meta_alpha(df: DataFrame, columns: list[str], y: str, fold: str, grid: list[float], folds: int = 3) -> tuple[float, dict[float, float]]:
    """Penalty of a ridge stacker by cross-validated MAE, ties to the larger; and all MAEs. One pass of sums, one of scores."""
    parts = moments(df, [*columns, y], fold)
    models = {(a, k): ridge(total(parts, (k,)), columns, a) for a in grid for k in range(folds)}
    errors = []
    for i, a in enumerate(grid):
        e = None
        for k in range(folds):
            d = F.abs(F.col(y) - models[(a, k)].predict())
            e = F.when(F.col(fold) == k, d) if e is None else e.when(F.col(fold) == k, d)
        errors.append(F.avg(e).alias(f"_{i}"))
    row = df.agg(*errors).first()
    maes = {a: row[f"_{i}"] for i, a in enumerate(grid)}
    return min(maes, key=lambda a: (round(maes[a], 15), -a)), maes


def fold_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, median, population sd and number of the folds' (or seeds') predictions of each key."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_pop(value).alias("sd"))


def solution_score(pred: DataFrame, solution: DataFrame, key: str, value: str, y: str, public: str, private: str) -> DataFrame:
    """One row ``n``, ``mae``, ``public_mae``, ``private_mae``; a row that is both or neither public and private fails the query."""
    joined = pred.join(solution, key)
    ok = F.coalesce(F.col(public) != F.col(private), F.lit(False))
    e = F.when(ok, F.abs(F.col(value) - F.col(y))).otherwise(F.raise_error(F.lit("a row must be either public or private")).cast("double"))
    return joined.agg(F.count("*").alias("n"), F.avg(e).alias("mae"), F.avg(F.when(F.col(public), e)).alias("public_mae"), F.avg(F.when(F.col(private), e)).alias("private_mae"))


def derived_scores(primary: str, shadow: str, public: str, private: str) -> list[Column]:
    """``cv_mean``, ``cv_worst``, ``cv_gap``, ``board_gap``; null if a part is."""
    p, s, u, v = map(F.col, (primary, shadow, public, private))
    both = p.isNotNull() & s.isNotNull()
    return [((p + s) / 2).alias("cv_mean"), F.when(both, F.greatest(p, s)).alias("cv_worst"), F.abs(p - s).alias("cv_gap"), F.abs(u - v).alias("board_gap")]


def rank_transfer(df: DataFrame, by: list[str], stages: list[str]) -> DataFrame:
    """Spearman and Kendall between all pairs of score columns over the rows that have both: ``by``, ``a``, ``b``, ``n``, ``spearman``, ``tau``."""
    out = None
    for a, b in combinations(stages, 2):
        rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        t = kendall(rows, by, a, b).withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(by)})
        s = spearman(rows, by, a, b)
        same = F.lit(True)
        for i, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        one = s.join(t.withColumnRenamed("n", "_n"), same).select(*by, F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "spearman", "tau")
        out = one if out is None else out.unionByName(one)
    return out


def paired_contrasts(df: DataFrame, matched: list[str], factor: str, x: str, y: str, scores: list[str]) -> DataFrame:
    """Level ``x`` against level ``y`` of a factor on equal other factors: ``matched``, ``delta_<score>`` and ``both_improve`` (all lower).

    A cell counts only if exactly one row matches it.
    """
    one = df.groupBy(*matched, factor).agg(F.count("*").alias("_n"), *[F.first(s).alias(s) for s in scores]).where("_n = 1").drop("_n")
    a = one.where(F.col(factor) == x).drop(factor)
    b = one.where(F.col(factor) == y).drop(factor).withColumnsRenamed({s: f"_{s}" for s in scores})
    d = a.join(b, matched).select(*matched, *[(F.col(s) - F.col(f"_{s}")).alias(f"delta_{s}") for s in scores])
    better = F.lit(True)
    for s in scores:
        better = better & (F.col(f"delta_{s}") < 0)
    return d.withColumn("both_improve", better)


def winner_regret(df: DataFrame, by: list[str], model: str, selector: str, outcome: str, bad_rho: float = -0.2, bad_regret: float = 1.5) -> DataFrame:
    """Outcome of the model with the least selector (ties by name) less the best outcome: ``by``, ``n``, ``winner``, ``regret``, ``spearman``, ``catastrophic``."""
    rows = df.where(F.col(selector).isNotNull() & F.col(outcome).isNotNull())
    win = rows.groupBy(*by).agg(F.min_by(F.struct(model, outcome), F.struct(selector, model)).alias("_w"), F.min(outcome).alias("_best"))
    rho = spearman(rows, by, selector, outcome)
    regret = F.col(f"_w.{outcome}") - F.col("_best")
    return win.join(rho, by).select(*by, "n", F.col(f"_w.{model}").alias("winner"), regret.alias("regret"), "spearman", (F.coalesce(F.col("spearman") < bad_rho, F.lit(False)) | (regret > bad_regret)).alias("catastrophic"))


def leave_one_family_out(df: DataFrame, by: list[str], model: str, family: str, selector: str, outcome: str, least: int = 3) -> DataFrame:
    """:func:`winner_regret` with each family left out in turn: ``left_out`` too; skipped where fewer than ``least`` models remain."""
    families = df.where(F.col(family).isNotNull()).select(*by, F.col(family).alias("left_out")).distinct()
    rest = df.join(families, by).where(F.col(family).isNull() | (F.col(family) != F.col("left_out")))
    return winner_regret(rest, [*by, "left_out"], model, selector, outcome).where(F.col("n") >= least)


def policy_stress(df: DataFrame, by: list[str], model: str, first: str, second: str, outcome: str, trajectories: int, catalogue: int, seed: int = 0) -> DataFrame:
    """Regret of selection policies over random orders of reveal: ``by``, ``policy``, ``n``, ``mean_regret``, ``median_regret``, ``p90_regret``, ``zero_fraction``.

    Every trajectory takes the first ``catalogue`` models in a hash order and ends with
    the policy's choice: least ``first``, least ``second``, or least sum of both ranks.
    A model table is small by its nature; trajectories are rows.
    """
    from chainloom.operators.folds import mix

    d = df.where(F.col(first).isNotNull() & F.col(second).isNotNull() & F.col(outcome).isNotNull()).select(*by, model, first, second, outcome)
    t = d.withColumn("trajectory", F.explode(F.sequence(F.lit(0), F.lit(trajectories - 1))))
    order = Window.partitionBy(*by, "trajectory").orderBy(mix(F.crc32(F.col(model)), F.col("trajectory") + seed), model)
    seen = t.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= catalogue)
    same = Window.partitionBy(*by, "trajectory")
    seen = seen.withColumn("_sum", F.rank().over(same.orderBy(first)) + F.rank().over(same.orderBy(second)))
    pick = lambda c: F.min_by(outcome, F.struct(F.col(c), F.col(model)))
    ends = seen.groupBy(*by, "trajectory").agg(F.min(outcome).alias("_best"), pick(first).alias("_first"), pick(second).alias("_second"), pick("_sum").alias("_balanced"))
    long = ends.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), (F.col(c) - F.col("_best")).alias("regret")) for n, c in (("FIRST", "_first"), ("SECOND", "_second"), ("BALANCED", "_balanced"))])).alias("p")).select(*by, "p.*")
    return long.groupBy(*by, "policy").agg(F.count("*").alias("n"), F.avg("regret").alias("mean_regret"), F.median("regret").alias("median_regret"), F.percentile("regret", F.lit(0.9)).alias("p90_regret"), F.avg((F.col("regret") <= 1e-12).cast("double")).alias("zero_fraction"))


def sign_pattern(columns: list[str], eps: float = 0.0) -> Column:
    """``+``, ``-``, ``0`` or ``?`` (null) of each column in one text."""
    return F.concat(*[F.when(F.col(c) > eps, "+").when(F.col(c) < -eps, "-").when(F.col(c).isNotNull(), "0").otherwise("?") for c in columns])


def ladder(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds; a null condition doesn't."""
    out = None
    for name, c in rules:
        c = F.coalesce(c, F.lit(False))
        out = F.when(c, name) if out is None else out.when(c, name)
    return out.otherwise(otherwise)


def leaderboard(df: DataFrame, by: list[str], metric: str, key: str, eligible: Column) -> DataFrame:
    """The best eligible row of each group by a metric (least, ties by key)."""
    return best_rows(df.where(F.coalesce(eligible, F.lit(False)) & F.col(metric).isNotNull() & ~F.isnan(metric)), by, [F.asc(metric), F.asc(key)])

