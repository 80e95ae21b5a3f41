"""Preprocessing and linear models from distributed sums (M family).

A model sees the data only through one pass of cross products: per fold the count, the
sums and the Gram matrix of at most a few hundred columns. A fold's training sums are
the total less the held-out folds', so all folds, rotations and penalties cost one pass.
The small systems are solved with NumPy on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.operators.aggregate import finite
from chainloom.operators.prefix import quantiles


@dataclass
class Moments:
    """Count, sums and cross products of the columns x_1 .. x_d, y."""

    n: float
    s: np.ndarray
    g: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.s + other.s, self.g + other.g)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.s - other.s, self.g - other.g)

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        mean = self.s / max(self.n, 1)
        return mean, self.g - self.n * np.outer(mean, mean)


def _sums(columns: list[str], by: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
            key = batch.column(by).to_numpy(zero_copy_only=False)
            for k in np.unique(key):
                part = x[key == k]
                m = Moments(len(part), part.sum(0), part.T @ part)
                total[k] = total[k] + m if k in total else m
        for k, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([int(k)]), pa.array([float(m.n)]), pa.array([m.s.tolist()]), pa.array([m.g.ravel().tolist()])], names=["fold", "n", "s", "g"])

    return run


def moments(df: DataFrame, columns: list[str], fold: str | None = None) -> dict[int, Moments]:
    """Sums per fold over rows in which all ``columns`` are finite; one row a task and fold reaches the driver (no fold: 0).

    Up to 12 columns the products are plain JVM aggregates; wider blocks are multiplied
    as matrices in Arrow batches. Columns are shifted by nothing, so scale them first if
    their means dwarf their deviations.
    """
    d = len(columns)
    known = df.select(F.coalesce(F.col(fold).cast("long"), F.lit(-1)).alias("fold") if fold else F.lit(0).cast("long").alias("fold"), *[finite(F.col(c).cast("double")).alias(c) for c in columns]).dropna()
    if d <= 12:
        products = [F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"_g{i}_{j}") for i in range(d) for j in range(i, d)]
        rows = known.groupBy("fold").agg(F.count("*").cast("double").alias("n"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(columns)], *products).collect()  # a row a fold
        out = {}
        for r in rows:
            g = np.zeros((d, d))
            for i in range(d):
                for j in range(i, d):
                    g[i, j] = g[j, i] = r[f"_g{i}_{j}"]
            out[r.fold] = Moments(r.n, np.array([r[f"_s{i}"] for i in range(d)]), g)
        return out
    parts = known.mapInArrow(_sums(columns, "fold"), "fold long, n double, s array<double>, g array<double>")
    # a task's matrices are summed entry by entry before they reach the driver
    long = parts.select("fold", "n", F.posexplode(F.concat("s", "g")).alias("i", "v")).groupBy("fold", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    cells: dict[int, list] = {}
    n: dict[int, float] = {}
    for r in long.collect():  # folds x (d + d^2) numbers
        cells.setdefault(r.fold, [0.0] * (d + d * d))[r.i] = r.v
        n[r.fold] = r.n
    return {k: Moments(n[k], np.array(v[:d]), np.array(v[d:]).reshape(d, d)) for k, v in cells.items()}


def total(parts: dict[int, Moments], leave: tuple[int, ...] = ()) -> Moments:
    left = [m for k, m in parts.items() if k not in leave and k >= 0]
    if not left:
        raise ValueError("no rows to fit on")
    out = left[0]
    for m in left[1:]:
        out = out + m
    return out


def covariance(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, population covariance and number of the complete rows."""
    m = total(moments(df, columns))
    mean, c = m.centred()
    return mean, c / max(m.n, 1), int(m.n)


@dataclass
class Linear:
    """Coefficients and intercept on the columns' own scale."""

    columns: list[str]
    coef: np.ndarray
    intercept: float

    def predict(self) -> Column:
        out = F.lit(float(self.intercept))
        for c, w in zip(self.columns, self.coef):
            out = out + F.lit(float(w)) * F.col(c)
        return out


def _scaled(m: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales (population sd, 1 for a constant), Gram matrix and X'y of the scaled columns; y is the last column."""
    mean, c = m.centred()
    sd = np.sqrt(np.maximum(np.diag(c)[:-1] / max(m.n, 1), 0.0))
    sd[sd < 1e-12] = 1.0
    return mean, sd, c[:-1, :-1] / np.outer(sd, sd), c[:-1, -1] / sd


def ridge(m: Moments, columns: list[str], alpha: float) -> Linear:
    """Minimises sum of squares + alpha |w|^2 on scaled columns with a free intercept."""
    mean, sd, g, b = _scaled(m)
    w = np.linalg.solve(g + alpha * np.eye(len(g)), b) / sd if alpha > 0 else np.linalg.lstsq(g, b, rcond=None)[0] / sd
    return Linear(columns, w, float(mean[-1] - w @ mean[:-1]))


def elastic_net(m: Moments, columns: list[str], alpha: float, l1_ratio: float = 1.0, tol: float = 1e-3, most_rounds: int = 200_000) -> Linear:
    """Cyclic coordinate descent on the Gram matrix of (1/2n) |y - Xw|^2 + alpha l1 |w|_1 + alpha (1 - l1) / 2 |w|^2; raises if it doesn't converge.

    ``l1_ratio`` 1 is the lasso.
    """
    mean, sd, g, b = _scaled(m)
    g, b = g / m.n, b / m.n
    yy = m.centred()[1][-1, -1] / m.n
    w = np.zeros(len(b))
    for _ in range(most_rounds):
        step = 0.0
        for j in range(len(b)):
            r = b[j] - g[j] @ w + g[j, j] * w[j]
            new = np.sign(r) * max(abs(r) - alpha * l1_ratio, 0.0) / (g[j, j] + alpha * (1 - l1_ratio)) if g[j, j] > 0 else 0.0
            step = max(step, abs(new - w[j]))
            w[j] = new
        if step <= tol * max(np.abs(w).max(), 1e-12) * 1e-6 or step == 0.0:
            # duality gap, relative to the variance of y
            res = b - g @ w
            dual = np.abs(res - alpha * (1 - l1_ratio) * w).max()
            if dual <= alpha * l1_ratio + tol * max(yy, 1e-12) or l1_ratio == 0:
                coef = w / sd
                return Linear(columns, coef, float(mean[-1] - coef @ mean[:-1]))
    raise RuntimeError(f"no convergence at alpha {alpha}")


def select_penalty(fit, train: Moments, val: DataFrame, columns: list[str], y: str, grid: list[float], larger: bool = True, places: int = 15) -> tuple[float, dict[float, float]]:
    """The penalty with the least MAE on ``val`` (one pass for the whole grid), ties to the larger; and all MAEs."""
    models = {a: fit(train, columns, a) for a in grid}
    row = val.agg(*[F.avg(F.abs(F.col(y) - m.predict())).alias(f"_{i}") for i, m in enumerate(models.values())]).first()
    maes = {a: row[f"_{i}"] for i, a in enumerate(models)}
    best = min(maes, key=lambda a: (round(maes[a], places), -a if larger else a))
    return best, maes


def rotation_oof(df: DataFrame, columns: list[str], y: str, fold: str, grid: list[float], folds: int = 5, fit=ridge, refit: str = "train+val") -> tuple[DataFrame, list[dict]]:
    """Out-of-fold predictions with TEST = k, VAL = k + 1: ``df`` plus ``oof``, and each rotation's penalty and coefficients.

    One pass gathers all folds' sums; one more scores every rotation's whole grid; the
    predictions are a column expression. ``refit``: on ``train+val`` or ``train`` only.
    Rows with a null fold or a missing number have no prediction.
    """
    cols = [*columns, y]
    parts = moments(df, cols, fold)
    usable = df.where(F.col(fold).isNotNull())
    for c in cols:
        usable = usable.where(finite(F.col(c).cast("double")).isNotNull())
    fits = {(k, a): fit(total(parts, (k, (k + 1) % folds)), columns, a) for k in range(folds) for a in grid}
    errors = [F.avg(F.when(F.col(fold) == (k + 1) % folds, F.abs(F.col(y) - m.predict()))).alias(f"_{i}") for i, ((k, _), m) in enumerate(fits.items())]
    row = usable.agg(*errors).first()
    chosen, out = [], None
    for k in range(folds):
        maes = {a: row[f"_{i}"] for i, (kk, a) in enumerate(fits) if kk == k}
        best = min(maes, key=lambda a: (round(maes[a], 15) if maes[a] is not None else float("inf"), -a))
        model = fits[(k, best)] if refit == "train" else fit(total(parts, (k,)), columns, best)
        chosen.append({"rotation": k, "alpha": float(best), "val_mae": maes[best], "intercept": model.intercept, "coef": model.coef.tolist()})
        out = F.when(F.col(fold) == k, model.predict()) if out is None else out.when(F.col(fold) == k, model.predict())
    return usable.withColumn("oof", out), chosen


def median_oof(df: DataFrame, y: str, fold: str, folds: int = 5) -> DataFrame:
    """The median of y over all other folds as ``oof``; null folds have none.

    Each row is in ``folds`` - 1 training sets; its value is counted before it is copied.
    """
    counted = df.where(F.col(fold).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(fold).alias("_f"), F.col(y).alias("_y")).count()
    copies = counted.withColumn("_test", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("_test != _f")
    meds = _weighted_median(copies, ["_test"], "_y", "count").withColumnRenamed("median", "oof")
    return df.join(F.broadcast(meds), df[fold] == meds["_test"], "left").drop("_test")  # a row a fold


def _weighted_median(df: DataFrame, by: list[str], value: str, n: str) -> DataFrame:
    from chainloom.operators.prefix import value_ranks

    r = value_ranks(df, by, value, weights=(n,))
    at = (F.col(f"total_{n}") - 1) * 0.5
    pick = lambda i: F.max(F.when((i >= F.col(f"before_{n}")) & (i < F.col(f"before_{n}") + F.col(n)), F.col(value)))
    return r.groupBy(*by).agg(((pick(F.floor(at)) + pick(F.ceil(at))) / 2).alias("median"))


# --- preprocessing


def fit_medians(df: DataFrame, columns: list[str], train: Column) -> dict[str, float]:
    """Median of each column over the train rows, 0 for a column without a value."""
    from chainloom.operators.aggregate import unpivoted

    q = quantiles(unpivoted(df.where(train), [], columns), ["feature"], "value", [0.5])
    found = {r.feature: r.q[0] for r in q.collect()}  # a row a column
    return {c: found.get(c, 0.0) for c in columns}


def fit_means(df: DataFrame, columns: list[str], train: Column) -> dict[str, float]:
    """Mean of each column over the train rows; columns without a value are left out."""
    row = df.where(train).agg(*[F.avg(finite(F.col(c).cast("double"))).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns if row[c] is not None}


def impute(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Missing (null, NaN, infinite) entries by the fitted values."""
    return df.withColumns({c: F.coalesce(finite(F.col(c).cast("double")), F.lit(float(v))) for c, v in values.items()})


def fit_scaler(df: DataFrame, columns: list[str], train: Column) -> dict[str, tuple[float, float]]:
    """Mean and population sd over the train rows; a constant column has scale 1."""
    cols = {c: finite(F.col(c).cast("double")) for c in columns}
    row = df.where(train).agg(*[F.avg(v).alias(f"m_{c}") for c, v in cols.items()], *[F.stddev_pop(v).alias(f"s_{c}") for c, v in cols.items()]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] if row[f"s_{c}"] and row[f"s_{c}"] >= 1e-12 else 1.0) for c in columns}


def scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, (m, s) in fitted.items()})


class FoldPreprocessor:
    """Impute and scale fitted on the train rows only: ``fit`` once, ``transform`` any table."""

    def __init__(self, columns: list[str], strategy: str = "median") -> None:
        if strategy not in ("median", "mean"):
            raise ValueError(f"unknown strategy {strategy}")
        self.columns, self.strategy = columns, strategy
        self.values: dict[str, float] | None = None

    def fit(self, df: DataFrame, train: Column) -> FoldPreprocessor:
        self.values = (fit_medians if self.strategy == "median" else fit_means)(df, self.columns, train)
        self.columns = [c for c in self.columns if c in self.values]
        self.scaler = fit_scaler(impute(df, self.values), self.columns, train)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.values is None:
            raise RuntimeError("fit first")
        return scale(impute(df, self.values), self.scaler)


def one_hot_most_frequent(df: DataFrame, column: str, train: Column) -> tuple[DataFrame, list[str]]:
    """Nulls become the most frequent train value (ties to the least), then 0/1 columns of the train categories; unknown values have all zeros."""
    counts = df.where(train & F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), F.asc(column)).collect()  # a row a category
    if not counts:
        return df, []
    filled = F.coalesce(F.col(column), F.lit(counts[0][column]))
    cats = sorted(r[column] for r in counts)
    return df.withColumns({f"{column}_{v}": (filled == F.lit(v)).cast("int") for v in cats}), [f"{column}_{v}" for v in cats]


@dataclass
class Pca:
    columns: list[str]
    mean: np.ndarray
    scale: np.ndarray
    axes: np.ndarray  # one column an axis
    variance: np.ndarray

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        outs = {}
        for j in range(self.axes.shape[1]):
            c = F.lit(0.0)
            for name, m, s, a in zip(self.columns, self.mean, self.scale, self.axes[:, j]):
                c = c + (F.col(name) - F.lit(float(m))) * F.lit(float(a / s))
            outs[f"{prefix}{j}"] = c
        return df.withColumns(outs)


def pca_block(df: DataFrame, columns: list[str], train: Column, most: int = 32, scaled: bool = False, forced: bool = False) -> Pca | None:
    """Principal axes of a column block over the train rows: min(``most``, n - 1, d) of them.

    None (leave the block alone) if that is under 2, or if the block has at most 200
    columns and isn't ``forced``. The greatest entry of an axis is positive.
    """
    if len(columns) <= 200 and not forced:
        return None
    mean, cov, n = covariance(df.where(train), columns)
    k = min(most, n - 1, len(columns))
    if k < 2:
        return None
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0)) if scaled else np.ones(len(columns))
    sd[sd < 1e-12] = 1.0
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    order = np.argsort(values)[::-1][:k]
    axes = vectors[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])
    return Pca(columns, mean, sd, axes, values[order])


def residualise(df: DataFrame, targets: list[str], predictors: list[str], train: Column, alpha: float = 1.0, prefix: str = "res_") -> tuple[DataFrame, dict[str, float]]:
    """Each target less what the predictors tell of it (ridge fitted on train), as ``prefix`` columns; and the train R2 of each.

    One pass of cross products serves all targets.
    """
    m = total(moments(df.where(train), [*predictors, *targets]))
    p = len(predictors)
    outs, r2 = {}, {}
    for t, name in enumerate(targets):
        pick = [*range(p), p + t]
        one = Moments(m.n, m.s[pick], m.g[np.ix_(pick, pick)])
        model = ridge(one, predictors, alpha)
        _, c = one.centred()
        ss = c[-1, -1]
        w = model.coef
        r2[name] = float(1 - (ss - 2 * w @ c[:-1, -1] + w @ c[:-1, :-1] @ w) / ss) if ss > 1e-12 else float("nan")
        outs[f"{prefix}{name}"] = F.col(name) - model.predict()
    return df.withColumns(outs), r2


def permutation_importance(df: DataFrame, model: Linear, blocks: dict[str, list[str]], y: str, key: str, fold: str, repeats: int = 5, seed: int = 0) -> DataFrame:
    """Rise of the MAE when a block's columns are dealt to other rows of the fold: ``fold``, ``block``, ``repeat``, ``increase``.

    The rows are re-paired by rank in two hash orders, so a permutation is one shuffle of
    the block's columns; all repeats run as one plan.
    """
    from chainloom.operators.prefix import order_hash, prefix_sum

    used = sorted({c for cols in blocks.values() for c in cols} | set(model.columns))
    base = df.select(fold, key, y, *used)
    reps = base.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    one = reps.withColumn("_one", F.lit(1)).withColumn("_h", order_hash(key, seed=seed))
    placed = prefix_sum(one, [fold, "repeat"], "_h", [key], "_one", "_i", bits=6)
    other = reps.withColumn("_one", F.lit(1)).withColumn("_h", order_hash(key, "repeat", seed=seed + 1))
    dealt = prefix_sum(other, [fold, "repeat"], "_h", [key], "_one", "_i", bits=6).select(F.col(fold).alias("_f"), F.col("repeat").alias("_r"), F.col("_i").alias("_j"), *[F.col(c).alias(f"_p_{c}") for c in used])
    both = placed.join(dealt, (F.col(fold) == F.col("_f")) & (F.col("repeat") == F.col("_r")) & (F.col("_i") == F.col("_j")))
    plain = F.abs(F.col(y) - model.predict())
    outs = []
    for name, cols in blocks.items():
        moved = F.lit(float(model.intercept))
        for c, w in zip(model.columns, model.coef):
            moved = moved + F.lit(float(w)) * F.col(f"_p_{c}" if c in cols else c)
        outs.append(F.struct(F.lit(name).alias("block"), (F.abs(F.col(y) - moved) - plain).alias("d")))
    long = both.select(fold, "repeat", F.explode(F.array(*outs)).alias("o")).select(fold, "repeat", "o.block", "o.d")
    return long.groupBy(fold, "block", "repeat").agg(F.avg("d").alias("increase"))


def mask_ablation(df: DataFrame, fitted: FoldPreprocessor, masked: list[str]) -> DataFrame:
    """Transformed columns with the ``masked`` ones set to 0 after scaling, which is their neutral value."""
    return fitted.transform(df).withColumns({c: F.lit(0.0) for c in masked if c in fitted.columns})
