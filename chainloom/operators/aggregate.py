"""Summaries of columns and groups (A family).

NaN and infinities count as missing unless a docstring says otherwise: pass columns
through :func:`finite` first. Whole-table quantiles come from range-partitioned ranks;
``percentile`` is used only within groups that are small by their meaning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainloom.operators.prefix import quantiles, value_ranks


def finite(c: Column | str) -> Column:
    """The number, or null if it is null, NaN or infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def with_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite(c) for c in columns})


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column ``feature``: n, missing, missing_fraction, mean, sample sd, median, min, max.

    A column without a finite value has null statistics; an empty table has n = 0 and a
    null missing_fraction.
    """
    long = unpivoted(df, [], columns)
    base = long.groupBy("feature").agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.count("*").alias("_rows"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    med = quantiles(long, ["feature"], "value", [0.5]).select(F.col("feature").alias("_f"), F.col("q")[0].alias("median"))
    return base.join(med, base.feature == med._f, "left").select(
        "feature", "n", "missing", F.try_divide("missing", "_rows").alias("missing_fraction"), "mean", "sd", "median", "min", "max"
    )


def unpivoted(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Long form ``keys``, ``feature``, ``value`` (double; null if not finite)."""
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), finite(F.col(c).cast("double")).alias("value")) for c in columns])
    return df.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.feature", "_e.value")


def iqr_outliers(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group: n, q1, q3 and ``n_out``, the values strictly outside q1 - 1.5 iqr .. q3 + 1.5 iqr."""
    ranks = value_ranks(df.withColumn(value, finite(value)), by, value)
    q = ranks.groupBy(*by).agg(*_quartiles(value)).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "q1", "q3")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)], F.lit(True))
    gap = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    outside = (F.col(value) < F.col("q1") - gap) | (F.col(value) > F.col("q3") + gap)
    # one row a group: as many as the result
    return ranks.join(q, same).groupBy(*by).agg(F.sum("n").alias("n"), F.first("q1").alias("q1"), F.first("q3").alias("q3"), F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("n_out"))


def _quartiles(value: str) -> list[Column]:
    out = []
    for p, name in ((0.25, "q1"), (0.75, "q3")):
        at = (F.col("total") - 1) * F.lit(p)
        a, b = (F.max(F.when((i >= F.col("before")) & (i < F.col("before") + F.col("n")), F.col(value))) for i in (F.floor(at), F.ceil(at)))
        out.append((a + (b - a) * F.max(at - F.floor(at))).alias(name))
    return out


def qc_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per ``feature``: finite_fraction, population sd, min, q05, median, q95, max and ``constant`` (sd below 1e-12)."""
    long = unpivoted(df, [], columns)
    base = long.groupBy("feature").agg(
        F.try_divide(F.count("value"), F.count("*")).alias("finite_fraction"), F.stddev_pop("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    q = quantiles(long, ["feature"], "value", [0.05, 0.5, 0.95]).withColumnRenamed("feature", "_f")
    return base.join(q, base.feature == q._f, "left").select(
        "feature", "finite_fraction", "sd", "min", F.col("q")[0].alias("q05"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q95"), "max",
        (F.coalesce("sd", F.lit(0.0)) < 1e-12).alias("constant"),
    )


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, sample sd, min, quartiles, max of the finite values of each group."""
    d = df.withColumn(value, finite(value))
    base = d.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = quantiles(d, by, value, [0.25, 0.5, 0.75]).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "q")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)], F.lit(True))
    return base.join(q, same, "left").select(*by, "n", "mean", "sd", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def value_counts(df: DataFrame, column: str, dropna: bool = True) -> DataFrame:
    """``column``, ``n`` and ``fraction`` of the counted rows; nulls count only if ``dropna`` is off."""
    rows = df.where(F.col(column).isNotNull()) if dropna else df
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy()))


def group_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: ``n_rows``, ``n_groups``, ``n_repeated`` (groups of more than one row), ``largest``; null keys are a group."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_groups"), F.count_if(F.col("_n") > 1).alias("n_repeated"), F.coalesce(F.max("_n"), F.lit(0)).alias("largest"))


def conflicts(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Groups with more than one label, nulls aside: ``keys``, ``n_rows``, ``n_labels``."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.countDistinct(label).alias("n_labels")).where("n_labels > 1")


def flags(df: DataFrame, by: list[str], conditions: dict[str, Column]) -> DataFrame:
    """Per group and condition ``any_<name>`` and ``all_<name>``; a null condition counts as false."""
    outs = []
    for name, c in conditions.items():
        c = F.coalesce(c, F.lit(False))
        outs += [F.bool_or(c).alias(f"any_{name}"), F.bool_and(c).alias(f"all_{name}")]
    return df.groupBy(*by).agg(*outs)


def two_level(df: DataFrame, inner: list[str], outer: list[str], value: str, first: str = "min", second: str = "median") -> DataFrame:
    """``second`` over the groups ``outer`` of ``first`` over the groups ``inner`` (a superset): ``outer``, ``n_inner``, ``value``."""
    one = df.groupBy(*inner).agg(STATS[first](finite(value)).alias("_v"))
    return one.groupBy(*outer).agg(F.count("_v").alias("n_inner"), STATS[second](F.col("_v")).alias("value"))


def weighted_mean(weight: Column | str, value: Column | str) -> Column:
    """Sum of w x over sum of w; null where the weights don't sum to more than 0. Rows lacking either don't count."""
    w, x = finite(weight), finite(value)
    both = w.isNotNull() & x.isNotNull()
    total = F.sum(F.when(both, w))
    return F.when(total > 0, F.sum(F.when(both, w * x)) / total)


def positive_mean(value: Column | str) -> Column:
    """Mean of max(x, 0) over all finite x."""
    return F.avg(F.greatest(finite(value), F.when(finite(value).isNotNull(), F.lit(0.0))))


def top_values(df: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """``by`` and the sorted array ``top`` of the ``k`` greatest finite values of each group.

    Partial results hold k values at most, so a group of any size is fine.
    """
    ranked = df.select(*by, finite(value).alias("_v")).where("_v is not null")
    salted = ranked.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    near = Window.partitionBy(*by, "_salt").orderBy(F.desc("_v"))
    few = salted.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= k)
    return few.groupBy(*by).agg(F.slice(F.sort_array(F.collect_list("_v"), asc=False), 1, k).alias("top"))


def top_stats(df: DataFrame, by: list[str], value: str, k: int = 5) -> DataFrame:
    """Per group: n finite values, max, mean, sum, sd (population), top-``k`` mean, positive-sum mean, top-``k`` share of the positive mass.

    The share is 0 where nothing is positive; groups without a finite value have nulls.
    """
    v = finite(value)
    base = df.groupBy(*by).agg(
        F.count(v).alias("n"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.sum(v).alias("sum"), F.stddev_pop(v).alias("sd"),
        positive_mean(value).alias("positive_mean"), F.sum(F.greatest(v, F.when(v.isNotNull(), F.lit(0.0)))).alias("_mass"),
    )
    tops = top_values(df, by, value, k).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "top")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)], F.lit(True))
    total = F.aggregate("top", F.lit(0.0), lambda a, x: a + x)
    positive = F.aggregate("top", F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0)))
    share = F.when(F.col("n") == 0, None).when(F.col("_mass") == 0, F.lit(0.0)).otherwise(F.try_divide(positive, F.col("_mass")))
    return base.join(tops, same, "left").select(
        *by, "n", "max", "mean", "sum", "sd", F.try_divide(total, F.size("top")).alias("top_mean"), "positive_mean", share.alias("top_share")
    )


def consensus(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """Per group and position the most frequent letter, ties to the least, joined to one string: ``by``, ``consensus``, ``n_texts``.

    Only texts long enough vote at a position. Null and empty texts have no vote; letters
    are counted before they are compared, so a hot group is small.
    """
    known = df.where(F.length(text) > 0)
    votes = known.groupBy(*by, text).agg(F.count("*").alias("_n")).select(*by, "_n", F.posexplode(F.split(text, "")).alias("_pos", "_ch"))
    counted = votes.groupBy(*by, "_pos", "_ch").agg(F.sum("_n").alias("_n"))
    best = counted.groupBy(*by, "_pos").agg(F.max_by("_ch", F.struct(F.col("_n"), -F.ascii("_ch"))).alias("_ch"))
    spelled = best.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_ch"))), lambda s: s["_ch"]), "").alias("consensus"))
    n = known.groupBy(*by).agg(F.count("*").alias("n_texts"))
    return spelled.join(n, by)


def coverage(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row about a feature table: ``n_rows``, ``n_keys``, ``n_repeated_rows``, ``missing_cells``, ``columns_with_missing``, ``has_infinite``."""
    nulls = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(f"_m{i}") for i, c in enumerate(columns)]
    inf = F.bool_or(reduce(lambda a, b: a | b, [F.coalesce(F.abs(F.col(c).cast("double")) == F.lit(float("inf")), F.lit(False)) for c in columns]))
    one = df.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.coalesce(inf, F.lit(False)).alias("has_infinite"), *nulls)
    cells = [F.col(f"_m{i}") for i in range(len(columns))]
    return one.select(
        "n_rows", "n_keys", (F.col("n_rows") - F.col("n_keys")).alias("n_repeated_rows"), reduce(lambda a, b: a + b, cells).alias("missing_cells"),
        reduce(lambda a, b: a + b, [(c > 0).cast("int") for c in cells]).alias("columns_with_missing"), "has_infinite",
    )


def cluster_stats(df: DataFrame, label: str) -> DataFrame:
    """One row about a labelling: ``n_groups``, ``largest``, ``median_size``, ``mean_size``, ``singleton_fraction``; null labels don't count."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("size"))
    # sizes repeat: the median over at most sqrt(2 rows) different sizes, weighted by their frequency
    freq = sizes.groupBy("size").agg(F.count("*").alias("n"))
    return freq.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_groups"), F.max("size").alias("largest"), F.expr("percentile(size, 0.5, n)").alias("median_size"),
        F.try_divide(F.sum(F.col("size") * F.col("n")), F.sum("n")).alias("mean_size"), F.try_divide(F.coalesce(F.sum(F.when(F.col("size") == 1, F.col("n"))), F.lit(0)), F.sum("n")).alias("singleton_fraction"),
    )


def boolean_overlap(a: Column, b: Column) -> list[Column]:
    """Counts ``n_both``, ``n_either``, ``n_xor``, ``n_neither`` of two flags; null is false."""
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return [F.count_if(a & b).alias("n_both"), F.count_if(a | b).alias("n_either"), F.count_if(a != b).alias("n_xor"), F.count_if(~a & ~b).alias("n_neither")]


def shannon_entropy(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Entropy in nats of the labels of each group: ``by``, ``n``, ``n_labels``, ``entropy``; null labels don't count."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("_n"))
    # -sum p ln p = ln N - sum n ln n / N
    return counts.groupBy(*by).agg(
        F.sum("_n").alias("n"), F.count("*").alias("n_labels"), (F.ln(F.sum("_n")) - F.sum(F.col("_n") * F.ln("_n")) / F.sum("_n")).alias("entropy")
    )


def bernoulli_entropy(p: Column) -> Column:
    """Mean of -p ln p - (1-p) ln(1-p) with p clipped to 1e-6 .. 1 - 1e-6."""
    q = F.when(p.isNotNull(), F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6)))
    return F.avg(-q * F.ln(q) - (1 - q) * F.ln(1 - q))


def masked_block(df: DataFrame, by: list[str], value: Column, masks: dict[str, Column], stats: tuple[str, ...] = ("count", "sum", "mean", "max"), on_empty: float | None = None) -> DataFrame:
    """All ``stats`` of ``value`` under all ``masks`` in one pass, columns ``<mask>_<stat>``.

    The generated columns are conditional aggregates of one groupBy. A mask without rows
    gives null, or ``on_empty`` (0.0 in some families); counts are 0.
    """
    outs = []
    for mask, cond in masks.items():
        picked = F.when(cond, finite(value))
        for s in stats:
            c = STATS[s](picked)
            outs.append((c if s == "count" or on_empty is None else F.coalesce(c, F.lit(on_empty))).alias(f"{mask}_{s}"))
    return df.groupBy(*by).agg(*outs)


#: Statistics by name, open for more: a name and a factory from column to aggregate.
STATS: dict = {
    "count": lambda c: F.count(c),
    "sum": lambda c: F.sum(c),
    "mean": lambda c: F.avg(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "sd": lambda c: F.stddev_samp(c),
    "sd_pop": lambda c: F.stddev_pop(c),
    "rms": lambda c: F.sqrt(F.avg(c * c)),
    "median": lambda c: F.percentile(c, F.lit(0.5)),
    "q90": lambda c: F.percentile(c, F.lit(0.9)),
    "q95": lambda c: F.percentile(c, F.lit(0.95)),
}


def register_stat(name: str, factory) -> None:
    """Add a statistic to :data:`STATS`; a taken name is an error."""
    if name in STATS:
        raise ValueError(f"statistic {name} exists")
    STATS[name] = factory


def cube_means(df: DataFrame, factors: list[str], value: str) -> DataFrame:
    """Mean and count of every combination of margins: ``factors`` (null where summed over), ``level``, ``n``, ``mean``."""
    return df.cube(*factors).agg(F.grouping_id().alias("level"), F.count(value).alias("n"), F.avg(value).alias("mean"))
