"""Compositions of linear models: nested, residual, per block, and other regressors (M family)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.operators.aggregate import finite
from chainloom.operators.linear import Linear, Moments, moments, ridge, total
from chainloom.operators.stats import pearson


def _usable(df: DataFrame, columns: list[str], fold: str) -> DataFrame:
    out = df.where(F.col(fold).isNotNull())
    for c in columns:
        out = out.where(finite(F.col(c).cast("double")).isNotNull())
    return out


def by_fold(models: dict[int, Linear], fold: str):
    out = None
    for k, m in models.items():
        out = F.when(F.col(fold) == k, m.predict()) if out is None else out.when(F.col(fold) == k, m.predict())
    return out


def plain_oof(df: DataFrame, columns: list[str], y: str, fold: str, alpha: float, folds: int = 5, fit=ridge, out: str = "oof") -> DataFrame:
    """Predictions of each fold by the model fitted on all others; one pass of sums."""
    parts = moments(df, [*columns, y], fold)
    return _usable(df, [*columns, y], fold).withColumn(out, by_fold({k: fit(total(parts, (k,)), columns, alpha) for k in range(folds)}, fold))


def nested_oof(df: DataFrame, columns: list[str], y: str, fold: str, grid: list[float], folds: int = 5, fit=ridge) -> tuple[DataFrame, list[dict]]:
    """Outer fold k is predicted by a model whose penalty is chosen by the mean MAE over the other folds, each held out once.

    Two passes over the data: the sums of all folds, and all inner errors at once. Ties
    go to the larger penalty. ``fold`` may come from groups, which makes it a grouped CV.
    """
    parts = moments(df, [*columns, y], fold)
    rows = _usable(df, [*columns, y], fold)
    keys, errors = [], []
    for k in range(folds):
        for a in grid:
            for j in range(folds):
                if j != k:
                    model = fit(total(parts, (k, j)), columns, a)
                    errors.append(F.avg(F.when(F.col(fold) == j, F.abs(F.col(y) - model.predict()))).alias(f"_{len(keys)}"))
                    keys.append((k, a))
    row = rows.agg(*errors).first()
    chosen, models = [], {}
    for k in range(folds):
        mean = {a: [row[f"_{i}"] for i, key in enumerate(keys) if key == (k, a) and row[f"_{i}"] is not None] for a in grid}
        score = {a: float(np.mean(v)) if v else float("inf") for a, v in mean.items()}
        best = min(score, key=lambda a: (round(score[a], 9), -a))
        models[k] = fit(total(parts, (k,)), columns, best)
        chosen.append({"fold": k, "alpha": float(best), "inner_mae": score[best]})
    return rows.withColumn("oof", by_fold(models, fold)), chosen


def residual_oof(df: DataFrame, reference: str, columns: list[str], y: str, fold: str, alpha: float, folds: int = 5) -> DataFrame:
    """Ridge on y - ``reference`` (frozen out-of-fold predictions), fitted on the other folds: ``residual`` and ``final`` = reference + residual.

    The reference must be out of fold itself, or it leaks; a row without one is left out.
    """
    d = df.withColumn("_res", F.col(y) - F.col(reference))
    out = plain_oof(d, columns, "_res", fold, alpha, folds, out="residual")
    return out.withColumn("final", F.col(reference) + F.col("residual")).drop("_res")


def feature_predictability(df: DataFrame, predictors: list[str], features: list[str], fold: str, alpha: float, folds: int = 5) -> DataFrame:
    """How well each feature is told by the predictors out of fold: ``feature``, ``n``, ``r2``, ``pearson``, ``nrmse`` (RMSE over sd). One pass of sums for all features."""
    parts = moments(df, [*predictors, *features], fold)
    p = len(predictors)
    out = _usable(df, [*predictors, *features], fold)
    aggs = []
    for t, name in enumerate(features):
        pick = [*range(p), p + t]
        one = {k: Moments(m.n, m.s[pick], m.g[np.ix_(pick, pick)]) for k, m in parts.items()}
        guess = by_fold({k: ridge(total(one, (k,)), predictors, alpha) for k in range(folds)}, fold)
        e = guess - F.col(name)
        aggs.append(F.struct(F.lit(name).alias("feature"), F.count(e).alias("n"), (1 - F.try_divide(F.avg(e * e), F.var_pop(name))).alias("r2"), pearson(F.col(name), guess).alias("pearson"), F.try_divide(F.sqrt(F.avg(e * e)), F.stddev_pop(name)).alias("nrmse")).alias(f"_{t}"))
    one = out.agg(*aggs)
    return one.select(F.explode(F.array(*[f"_{t}" for t in range(len(features))])).alias("r")).select("r.*")


def block_oof(df: DataFrame, blocks: dict[str, list[str]], y: str, fold: str, alpha: float, most: int = 32, forced: bool = False, raw: tuple[str, ...] = (), folds: int = 5) -> DataFrame:
    """Ridge on blocks, each reduced to principal axes that are fitted on the training folds only; blocks in ``raw`` and small ones stay as they are.

    Axes are linear, so the cross products of the axes follow from those of the columns:
    the data are read once for all folds and blocks.
    """
    columns = [c for cols in blocks.values() for c in cols]
    place = {c: i for i, c in enumerate(columns)}
    parts = moments(df, [*columns, y], fold)
    models: dict[int, Linear] = {}
    for k in range(folds):
        m = total(parts, (k,))
        mean, c = m.centred()
        maps = []
        for name, cols in blocks.items():
            at = [place[x] for x in cols]
            axes = min(most, int(m.n) - 1, len(cols))
            if name in raw or axes < 2 or (len(cols) <= 200 and not forced):
                t = np.eye(len(cols))
            else:
                values, vectors = np.linalg.eigh(c[np.ix_(at, at)])
                t = vectors[:, np.argsort(values)[::-1][:axes]]
            full = np.zeros((len(columns), t.shape[1]))
            full[at] = t
            maps.append(full)
        t = np.hstack(maps)
        wide = np.zeros((len(columns) + 1, t.shape[1] + 1))
        wide[:-1, :-1] = t
        wide[-1, -1] = 1.0
        reduced = Moments(m.n, wide.T @ m.s, wide.T @ m.g @ wide)
        inner = ridge(reduced, [f"z{i}" for i in range(t.shape[1])], alpha)
        models[k] = Linear(columns, t @ inner.coef, inner.intercept)
    return _usable(df, [*columns, y], fold).withColumn("oof", by_fold(models, fold))


def pls(m: Moments, columns: list[str], components: int) -> Linear:
    """Partial least squares with one response, from the cross products of scaled columns."""
    mean, c = m.centred()
    sd = np.sqrt(np.maximum(np.diag(c)[:-1] / max(m.n, 1), 0.0))
    sd[sd < 1e-12] = 1.0
    g, b = c[:-1, :-1] / np.outer(sd, sd), c[:-1, -1] / sd
    basis = []
    w = b.copy()
    for _ in range(min(components, len(columns))):  # the Krylov space of (g, b) is that of PLS
        for v in basis:
            w = w - v * (v @ w)
        norm = np.linalg.norm(w)
        if norm < 1e-12:
            break
        basis.append(w / norm)
        w = g @ basis[-1]
    k = np.array(basis).T
    coef = (k @ np.linalg.lstsq(k.T @ g @ k, k.T @ b, rcond=None)[0]) / sd if len(basis) else np.zeros(len(columns))
    return Linear(columns, coef, float(mean[-1] - coef @ mean[:-1]))


def kernel_ridge_oof(df: DataFrame, key: str, columns: list[str], y: str, fold: str, gamma: float, alpha: float, landmarks: int = 256, folds: int = 5) -> DataFrame:
    """RBF kernel ridge out of fold by Nystroem features: ``df`` plus ``oof``.

    ``landmarks`` rows, first in hash order of ``key``, span the kernel (a documented,
    bounded sample); the features are made in Arrow batches and the ridge sees all rows.
    """
    rows = _usable(df, [*columns, y], fold)
    picked = rows.select(F.xxhash64(key).alias("_h"), *columns).orderBy("_h").limit(landmarks).collect()
    z = np.array([[float(r[c]) for c in columns] for r in picked]).reshape(-1, len(columns))
    d = len(z)
    kz = np.exp(-gamma * ((z[:, None] - z[None]) ** 2).sum(-1))
    values, vectors = np.linalg.eigh(kz + 1e-9 * np.eye(d))
    root = vectors / np.sqrt(np.maximum(values, 1e-9))
    names = [f"_k{i}" for i in range(d)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns])
            k = np.exp(-gamma * ((x[:, None] - z[None]) ** 2).sum(-1)) @ root
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(k[:, i]) for i in range(d)]], names=[*batch.schema.names, *names])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], *[f"{n} double" for n in names]])
    wide = rows.mapInArrow(run, schema)
    return plain_oof(wide, names, y, fold, alpha, folds).drop(*names)


def huber(df: DataFrame, columns: list[str], y: str, epsilon: float = 1.35, alpha: float = 0.0) -> Linear:
    """Huber regression by Spark ML over all rows with finite numbers."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = df
    for c in [*columns, y]:
        rows = rows.where(finite(F.col(c).cast("double")).isNotNull())
    wide = VectorAssembler(inputCols=columns, outputCol="_x").transform(rows)
    fitted = LinearRegression(featuresCol="_x", labelCol=y, loss="huber", epsilon=epsilon, regParam=alpha, maxIter=100).fit(wide)
    return Linear(columns, fitted.coefficients.toArray(), float(fitted.intercept))


def boosted_trees(train: DataFrame, test: DataFrame, columns: list[str], y: str, group: str, rounds: int = 50, depth: int = 3, held_out: float = 0.2, seed: int = 0) -> DataFrame:
    """Boosted trees with early stopping on whole held-out groups, then ``test`` with ``prediction``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    late = F.pmod(F.xxhash64(F.lit(seed), group), F.lit(1000)) < int(held_out * 1000)
    wide = VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="keep")
    fitted = GBTRegressor(featuresCol="_x", labelCol=y, maxIter=rounds, maxDepth=depth, seed=seed, validationIndicatorCol="_late").fit(wide.transform(train.withColumn("_late", late)))
    return fitted.transform(wide.transform(test)).drop("_x")


def random_penalties(n: int, low: float, high: float, seed: int = 0) -> list[float]:
    """``n`` penalties spread log-uniformly over 10^low .. 10^high, from a seed."""
    return [float(10**v) for v in np.sort(np.random.default_rng(seed).uniform(low, high, n))]


