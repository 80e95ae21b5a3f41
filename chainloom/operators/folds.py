"""Grouped splits, folds, samples and resampling (K family).

Random choices are integer hashes of a key and a seed, so a result doesn't depend on
partitions or on the order of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainloom.operators.prefix import prefix_sum, value_ranks

MODULUS = 2**32
# fixed values: Poisson(1) cumulative probabilities at 0 .. 7, times 2^32, rounded down
POISSON_CUTS = tuple(int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * MODULUS) for k in range(8))


def mix(key: Column | str, seed: Column | int = 0) -> Column:
    """32-bit hash of an integer key by integer arithmetic alone, the same in any engine: two rounds of multiply and fold."""
    k = F.pmod((F.col(key) if isinstance(key, str) else key).cast("long"), F.lit(2**31))
    s = (F.lit(seed) if isinstance(seed, int) else seed).cast("long")
    a = F.pmod(k * F.lit(2654435761) + s * F.lit(40503) + F.lit(12345), F.lit(MODULUS))
    b = F.pmod(a.bitwiseXOR(F.shiftright(a, 15)) * F.lit(1540483477), F.lit(MODULUS))
    return b.bitwiseXOR(F.shiftright(b, 13))


def mix_sql(key: str, seed: str = "0") -> str:
    """:func:`mix` as SQL."""
    a = f"((({key}) % 2147483648) * 2654435761 + ({seed}) * 40503 + 12345) % 4294967296"
    b = f"((xor(({a})::bigint, (({a})::bigint >> 15)) * 1540483477::hugeint) % 4294967296)::bigint"
    return f"xor({b}, ({b}) >> 13)"


def assign_groups(df: DataFrame, group: str, shares: dict[str, float], rest: str, seed: int = 0) -> DataFrame:
    """Whole groups to roles in hash order: the first role until its share of the rows is reached, then the next, then ``rest``.

    ``group`` (integer), ``size``, ``role``. A group goes to the first role whose quota
    isn't reached before it. The running total is taken per hash bucket, not in one task.
    """
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("size"))
    h = sizes.withColumn("_h", F.shiftleft(mix(group, seed), 31))
    run = prefix_sum(h, [], "_h", [group], "size", "_before")
    total = sizes.agg(F.sum("size").alias("_all"))
    placed = run.crossJoin(F.broadcast(total))  # one row
    role, upto = None, 0.0
    for name, share in shares.items():
        upto += share
        test = F.col("_before") < F.col("_all") * F.lit(upto)
        role = F.when(test, name) if role is None else role.when(test, name)
    return placed.select(group, "size", role.otherwise(rest).alias("role"))


def level_fill(loads: list[int], size: int, n: int) -> list[int]:
    """How many of ``n`` groups of equal ``size`` each fold gets if each goes to the fold with the least load, ties to the first."""
    low, high = min(loads), max(loads) + size * (n + 1)
    count = lambda t: sum(max(0, -(-(t - v) // size)) for v in loads)  # slots (load + j size) below t
    while low < high:  # greatest t with at most n slots below it
        mid = (low + high + 1) // 2
        low, high = (mid, high) if count(mid) <= n else (low, mid - 1)
    out = [max(0, -(-(low - v) // size)) for v in loads]
    left = n - sum(out)
    for f, v in enumerate(loads):
        if left and v + out[f] * size == low:
            out[f] += 1
            left -= 1
    return out


def balanced_folds(df: DataFrame, group: str, folds: int, seed: int = 0) -> DataFrame:
    """Whole groups to folds of nearly equal rows, largest groups first, each into the smallest fold: ``group``, ``size``, ``fold``.

    Groups of equal size are exchangeable: the driver sees only how many groups have
    which size (at most the root of twice the rows), and the groups are dealt by their
    rank in hash order within their size.
    """
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("size"))
    loads, cuts = [0] * folds, []
    for r in sizes.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect():
        first = 0
        for f, n in enumerate(level_fill(loads, r["size"], r["n"])):
            if n:
                cuts.append((r["size"], first, first + n, f))
                first += n
                loads[f] += n * r["size"]
    table = df.sparkSession.createDataFrame(cuts, "_size long, _from long, _to long, fold int")
    one = sizes.withColumns({"_h": F.shiftleft(mix(F.xxhash64(group), seed), 31), "_one": F.lit(1)})
    ranked = prefix_sum(one, ["size"], "_h", [group], "_one", "_rank")
    # at most folds rows for each size
    hit = (F.col("size") == F.col("_size")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return ranked.join(table, hit).select(group, "size", "fold")


def repeated_folds(df: DataFrame, group: str, folds: int, repeats: int, seed: int = 17) -> DataFrame:
    """Round-robin folds over groups in a new hash order for each repeat: ``repeat``, ``group``, ``fold``; seeds are 1000 r + ``seed``."""
    groups = df.where(F.col(group).isNotNull()).select(group).distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    ranks = value_ranks(groups.withColumn("_h", mix(group, F.col("repeat") * 1000 + seed)), ["repeat"], "_h", group)
    return ranks.select("repeat", group, F.pmod("before", F.lit(folds)).cast("int").alias("fold"))


def early_stop_groups(df: DataFrame, group: str, fraction: float, seed: int = 0) -> DataFrame:
    """About ``fraction`` of the groups, at least one, first in hash order."""
    groups = df.where(F.col(group).isNotNull()).select(group).distinct().withColumn("_h", mix(group, seed))
    ranks = value_ranks(groups, [], "_h", group)
    return ranks.where(F.col("before") < F.greatest(F.lit(1), F.round(F.col("total") * fraction).cast("long"))).select(group)


def stratified_sample(df: DataFrame, strata: list[str], key: str, per_stratum: int, unique: str | None = None, forced: Column | None = None, seed: int = 0) -> DataFrame:
    """``per_stratum`` rows of each stratum in hash order, ``forced`` ones first, each value of ``unique`` at most once a stratum."""
    d = df.withColumns({"_h": mix(key, seed), "_late": (~F.coalesce(forced, F.lit(False))).cast("int") if forced is not None else F.lit(1)})
    if unique:
        d = d.withColumn("_u", F.row_number().over(Window.partitionBy(*strata, unique).orderBy("_late", "_h", key))).where("_u = 1").drop("_u")
    w = Window.partitionBy(*strata).orderBy("_late", "_h", key)
    return d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_stratum).drop("_r", "_h", "_late")


def poisson_weight(h: Column) -> Column:
    """Bootstrap weight (Poisson with mean 1) from a 32-bit hash."""
    out = F.lit(0)
    for cut in POISSON_CUTS:
        out = out + (h >= cut).cast("int")
    return out


def poisson_weight_sql(h: str) -> str:
    return "(" + " + ".join(f"({h} >= {c})::int" for c in POISSON_CUTS) + ")"


def _mixed(k: np.ndarray, s: np.ndarray) -> np.ndarray:
    """:func:`mix` of all pairs of a key and a seed."""
    a = ((k % 2**31)[:, None] * np.int64(2654435761) + s[None] * np.int64(40503) + 12345) % MODULUS
    b = (a ^ (a >> 15)).astype(np.uint64) * np.uint64(1540483477) % np.uint64(MODULUS)
    return b ^ (b >> np.uint64(13))


def _weighted(by: list[str], key: str, columns: list[str], replicates: int, seed: int):
    seeds = np.arange(replicates, dtype=np.int64) + seed * 1_000_003
    cuts = np.array(POISSON_CUTS, np.uint64)

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 20_000):
                batch = whole.slice(at, 20_000)
                frame = batch.to_pandas()
                values = np.column_stack([np.ones(len(frame)), *[np.nan_to_num(frame[c].to_numpy(np.float64)) for c in columns]])
                weights = np.searchsorted(cuts, _mixed(frame[key].to_numpy(np.int64), seeds), side="right")
                groups = frame.groupby(by, dropna=False, sort=False).indices if by else {(): np.arange(len(frame))}
                for rows in groups.values():
                    sums = weights[rows].T @ values[rows]
                    head = batch.select(by).slice(int(rows[0]), 1) if by else None
                    parts = [pa.array([head.column(b)[0].as_py()] * replicates, batch.schema.field(b).type) for b in by]
                    yield pa.RecordBatch.from_arrays([*parts, pa.array(np.arange(replicates, dtype=np.int32)), *[pa.array(sums[:, j]) for j in range(sums.shape[1])]], names=[*by, "replicate", "_n", *columns])

    return run


def bootstrap_sums(df: DataFrame, by: list[str], key: str, columns: dict[str, Column], replicates: int, seed: int = 0) -> DataFrame:
    """Sums of each column under every replicate's weights: ``by``, ``replicate``, ``_n`` (sum of weights), names.

    A row's weight in a replicate is a hash of its integer ``key``, so rows are never
    shuffled or copied: an Arrow batch is multiplied by its weight matrix, and only sums
    of a group and replicate move. Nulls count as 0.
    """
    rows = df.select(*by, F.col(key).cast("long").alias("_key"), *[c.cast("double").alias(n) for n, c in columns.items()])
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in by]
    parts = rows.mapInArrow(_weighted(by, "_key", list(columns), replicates, seed), ", ".join([*kinds, "replicate int", "_n double", *[f"`{n}` double" for n in columns]]))
    return parts.groupBy(*by, "replicate").agg(F.sum("_n").alias("_n"), *[F.sum(n).alias(n) for n in columns])


def bootstrap_means(df: DataFrame, by: list[str], key: str, values: dict[str, Column], replicates: int, seed: int = 0) -> DataFrame:
    """Weighted means of each value for every replicate, nulls aside: ``by``, ``replicate``, names."""
    columns = {**{f"_s_{n}": v for n, v in values.items()}, **{f"_k_{n}": v.isNotNull() for n, v in values.items()}}
    s = bootstrap_sums(df, by, key, {n: c.cast("double") for n, c in columns.items()}, replicates, seed)
    return s.select(*by, "replicate", *[F.try_divide(f"_s_{n}", f"_k_{n}").alias(n) for n in values])


def percentile_interval(boot: DataFrame, by: list[str], value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Mean, bounds and the share of replicates below 0 (``p_below``) over a bounded number of replicates."""
    return boot.groupBy(*by).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(low)).alias("low"), F.percentile(value, F.lit(high)).alias("high"), F.avg((F.col(value) < 0).cast("double")).alias("p_below"))


def bootstrap_correlations(df: DataFrame, by: list[str], key: str, y: str, predictions: list[str], replicates: int, seed: int = 0) -> DataFrame:
    """Pearson correlation of y with each prediction in every replicate, from weighted sums: ``by``, ``replicate``, names."""
    p = {f"_p{i}": F.col(c) for i, c in enumerate(predictions)}
    columns = {"_y": F.col(y), "_yy": F.col(y) * F.col(y), **p, **{f"_pp{i}": F.col(c) * F.col(c) for i, c in enumerate(predictions)}, **{f"_py{i}": F.col(c) * F.col(y) for i, c in enumerate(predictions)}}
    whole = df.dropna(subset=[y, *predictions])
    s = bootstrap_sums(whole, by, key, columns, replicates, seed)

    def r(i: int) -> Column:
        n = F.col("_n")
        cov = n * F.col(f"_py{i}") - F.col(f"_p{i}") * F.col("_y")
        var = (n * F.col(f"_pp{i}") - F.col(f"_p{i}") ** 2) * (n * F.col("_yy") - F.col("_y") ** 2)
        return F.when(var > 0, cov / F.sqrt(var))

    return s.select(*by, "replicate", *[r(i).alias(p) for i, p in enumerate(predictions)])


def win_probability(boot: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Share of replicates in which ``a`` beats ``b``, ties half: ``by``, ``p_win``."""
    win = F.when(F.col(a) > F.col(b), 1.0).when(F.col(a) == F.col(b), 0.5).otherwise(0.0)
    return boot.groupBy(*by).agg(F.avg(win).alias("p_win"))


def subset_convergence(df: DataFrame, group: str, key: str, value: str, sizes: list[int], draws: int, seed: int = 0) -> DataFrame:
    """Monte-Carlo subsets without replacement: per ``group`` and subset size the median estimate's mean absolute deviation from the full median over its sd, and the sd over draws.

    ``group``, ``size``, ``reference``, ``deviation``, ``mc_sd``, ``noise_ratio``. Groups
    are ensembles of frames, small by their meaning; draws are hash orders.
    """
    d = df.where(F.col(value).isNotNull()).select(group, key, value)
    full = d.groupBy(group).agg(F.median(value).alias("reference"), F.stddev_pop(value).alias("_sd"))
    drawn = d.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    w = Window.partitionBy(group, "draw").orderBy(mix(key, F.col("draw") + seed), key)
    placed = drawn.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(sizes))
    each = placed.withColumn("size", F.explode(F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s >= F.col("_r"))))
    est = each.groupBy(group, "draw", "size").agg(F.median(value).alias("_m"), F.count("*").alias("_n")).where("_n = size")
    both = est.join(full, group)
    return both.groupBy(group, "size").agg(
        F.first("reference").alias("reference"), F.avg(F.try_divide(F.abs(F.col("_m") - F.col("reference")), F.nullif("_sd", F.lit(0.0)))).alias("deviation"), F.stddev_pop("_m").alias("mc_sd"),
        F.try_divide(F.stddev_pop("_m"), F.nullif(F.first("_sd"), F.lit(0.0))).alias("noise_ratio"),
    )


# --- split search


def split_energy(sizes: np.ndarray, labels: np.ndarray, mask: np.ndarray, target: int) -> float:
    """Squared miss of the target size plus that of half of every label, relative."""
    size = sizes[mask].sum() - target
    half = labels[mask].sum(0) - labels.sum(0) * (target / max(sizes.sum(), 1))
    return float((size / max(target, 1)) ** 2 + ((half / np.maximum(labels.sum(0), 1)) ** 2).sum())


def _search(rng: np.random.Generator, sizes: np.ndarray, labels: np.ndarray, target: int, method: str, steps: int) -> tuple[np.ndarray, float]:
    order = rng.permutation(len(sizes))
    mask = np.zeros(len(sizes), bool)
    left = target
    for g in order:
        if sizes[g] <= left:
            mask[g] = True
            left -= sizes[g]
    energy = split_energy(sizes, labels, mask, target)
    heat = 0.05 if method == "anneal" else 0.0
    best, least = mask.copy(), energy
    for step in range(steps):
        trial = mask.copy()
        inside, outside = np.flatnonzero(mask), np.flatnonzero(~mask)
        if len(inside) and rng.random() < 0.8:
            trial[rng.choice(inside)] = False
        if len(outside) and rng.random() < 0.8:
            trial[rng.choice(outside)] = True
        e = split_energy(sizes, labels, trial, target)
        t = heat * (1 - step / steps)
        if e < energy or (t > 0 and rng.random() < math.exp(-(e - energy) / t)):
            mask, energy = trial, e
            if e < least:
                best, least = trial.copy(), e
    return best, least


def split_search(spark, sizes: list[int], labels: list[list[int]], target: int, starts: int, method: str = "swap", steps: int = 300, seed: int = 0) -> DataFrame:
    """Search for a set of groups of ``target`` rows with half of each label: one row for each distinct mask, best first start kept.

    ``mask_hash``, ``start``, ``energy``, ``size``, ``mask`` (group numbers). Starts run in
    parallel by seed; ``method`` is ``swap`` (greedy and swaps) or ``anneal``. The groups
    of one search are few by its nature (their table is a parameter).
    """
    if len(sizes) > 100_000:
        raise ValueError("too many groups for one search")
    s, lab = np.array(sizes), np.array(labels, float).reshape(len(sizes), -1)

    def run(frames):
        import hashlib

        for f in frames:
            rows = []
            for i in f["id"]:
                mask, e = _search(np.random.default_rng([seed, int(i)]), s, lab, target, method, steps)
                on = np.flatnonzero(mask).tolist()
                rows.append((hashlib.sha256(",".join(map(str, on)).encode()).hexdigest()[:16], int(i), round(e, 9), int(s[mask].sum()), on))
            yield pd.DataFrame(rows, columns=["mask_hash", "start", "energy", "size", "mask"])

    found = spark.range(starts).mapInPandas(run, "mask_hash string, start long, energy double, size long, mask array<long>")
    return found.groupBy("mask_hash").agg(F.min_by(F.struct("start", "energy", "size", "mask"), "start").alias("_b")).select("mask_hash", "_b.*")


def energy_scale(spark, sizes: list[int], labels: list[list[int]], target: int, samples: int = 200, seed: int = 0) -> float:
    """Median energy of random feasible masks, to scale a search's temperature."""
    rows = split_search(spark, sizes, labels, target, samples, "swap", 0, seed).select("energy").collect()  # one row a sample
    return float(np.median([r.energy for r in rows])) if rows else float("nan")
