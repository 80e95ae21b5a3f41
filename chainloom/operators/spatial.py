"""Points in space within groups: range joins, fields, patches, contacts, pooling (G family).

A range join meets only points in the same or neighbouring cells of a grid as wide as
the radius, so it is an equi-join on group and cell, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.operators.components import connected_components
from chainloom.operators.prefix import quantiles

XYZ = ("x", "y", "z")


def _cell(c: str, width: float) -> Column:
    return F.floor(F.col(c) / width)


def range_pairs(a: DataFrame, b: DataFrame, group: list[str], key: str, radius: float, axes: tuple[str, ...] = XYZ, keep: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of a point of ``a`` and one of ``b`` in the same group at most ``radius`` apart.

    ``group``, ``key_a``, ``key_b``, ``d`` and, for each column of ``keep``, ``<c>_a``,
    ``<c>_b``. Points with a missing coordinate are in no pair. A point pairs with itself
    if both tables hold it.
    """
    fine = lambda df: reduce(lambda d, c: d.where(F.abs(c) < float("inf")), axes, df)
    cells = [_cell(c, radius) for c in axes]
    left = fine(a).select(*group, F.col(key).alias("key_a"), *[F.col(c).alias(f"{c}_a") for c in dict.fromkeys((*axes, *keep))], *[c.alias(f"_c{i}") for i, c in enumerate(cells)])
    steps = F.array(*[F.lit(s) for s in (-1, 0, 1)])
    right = fine(b).select(*group, F.col(key).alias("key_b"), *[F.col(c).alias(f"{c}_b") for c in dict.fromkeys((*axes, *keep))], *[c.alias(f"_c{i}") for i, c in enumerate(cells)])
    for i in range(len(axes)):
        right = right.withColumn("_s", F.explode(steps)).withColumn(f"_c{i}", F.col(f"_c{i}") + F.col("_s")).drop("_s")
    joined = left.join(right, [*group, *[f"_c{i}" for i in range(len(axes))]])
    d2 = reduce(lambda s, c: s + (F.col(f"{c}_a") - F.col(f"{c}_b")) * (F.col(f"{c}_a") - F.col(f"{c}_b")), axes[1:], (F.col(f"{axes[0]}_a") - F.col(f"{axes[0]}_b")) * (F.col(f"{axes[0]}_a") - F.col(f"{axes[0]}_b")))
    near = joined.withColumn("_d2", d2).where(F.col("_d2") <= radius * radius)
    return near.select(*group, "key_a", "key_b", F.sqrt("_d2").alias("d"), *[f"{c}_{s}" for c in keep for s in "ab"])


def all_distances(df: DataFrame, group: list[str], key: str, axes: tuple[str, ...] = XYZ) -> DataFrame:
    """Distances of all pairs (a < b) within a group, for groups that are molecules: ``group``, ``key_a``, ``key_b``, ``d``."""
    a = df.select(*group, F.col(key).alias("key_a"), *[F.col(c).alias(f"{c}_a") for c in axes])
    b = df.select(*group, F.col(key).alias("key_b"), *[F.col(c).alias(f"{c}_b") for c in axes])
    d2 = reduce(lambda s, c: s + (F.col(f"{c}_a") - F.col(f"{c}_b")) ** 2, axes, F.lit(0.0))
    return a.join(b, group).where("key_a < key_b").select(*group, "key_a", "key_b", F.sqrt(d2).alias("d"))


def closest_atoms(atoms: DataFrame, group: list[str], residue: str, axes: tuple[str, ...] = XYZ) -> DataFrame:
    """Least distance of any two atoms of each pair of residues (a < b) of a group."""
    a = atoms.select(*group, F.col(residue).alias("key_a"), *[F.col(c).alias(f"{c}_a") for c in axes])
    b = atoms.select(*group, F.col(residue).alias("key_b"), *[F.col(c).alias(f"{c}_b") for c in axes])
    d2 = reduce(lambda s, c: s + (F.col(f"{c}_a") - F.col(f"{c}_b")) ** 2, axes, F.lit(0.0))
    return a.join(b, group).where("key_a < key_b").groupBy(*group, "key_a", "key_b").agg(F.sqrt(F.min(d2)).alias("d"))


def neighbour_sums(df: DataFrame, group: list[str], key: str, weight: Column, radius: float, axes: tuple[str, ...] = XYZ) -> DataFrame:
    """For each point the sum of ``weight`` over the points at most ``radius`` away, itself included: ``group``, ``key``, ``total``, ``n``.

    Missing weights count 0; a point without a position has a null total.
    """
    d = df.withColumn("_w", F.coalesce(F.when(F.abs(weight) < float("inf"), weight), F.lit(0.0)))
    pairs = range_pairs(d, d, group, key, radius, axes, ("_w",))
    sums = pairs.groupBy(*group, "key_a").agg(F.sum("_w_b").alias("total"), F.count("*").alias("n"))
    return d.select(*group, F.col(key).alias("key_a")).join(sums, [*group, "key_a"], "left").select(*group, F.col("key_a").alias(key), "total", F.coalesce("n", F.lit(0)).alias("n"))


def exponential_field(points: DataFrame, sources: DataFrame, group: list[str], key: str, weight: str, radius: float, axes: tuple[str, ...] = XYZ) -> DataFrame:
    """At each point the sum of source weight times exp(-distance) over sources at most ``radius`` away, 0 if none: ``group``, ``key``, ``field``."""
    src = sources.withColumn("_w", F.col(weight))
    pairs = range_pairs(points.withColumn("_w", F.lit(0.0)), src, group, key, radius, axes, ("_w",))
    sums = pairs.groupBy(*group, "key_a").agg(F.sum(F.col("_w_b") * F.exp(-F.col("d"))).alias("field"))
    return points.select(*group, F.col(key).alias("key_a")).join(sums, [*group, "key_a"], "left").select(*group, F.col("key_a").alias(key), F.coalesce("field", F.lit(0.0)).alias("field"))


def pair_sum(df: DataFrame, group: list[str], key: str, weight: str, exposed: Column, radius: float, axes: tuple[str, ...] = XYZ) -> DataFrame:
    """Per group the sum over pairs of exposed points, 0 < r < ``radius``, of w_i w_j / r^2: ``group``, ``n_pairs``, ``total``."""
    d = df.where(exposed)
    pairs = range_pairs(d, d, group, key, radius, axes, (weight,)).where((F.col("key_a") < F.col("key_b")) & (F.col("d") > 0) & (F.col("d") < radius))
    return pairs.groupBy(*group).agg(F.count("*").alias("n_pairs"), F.sum(F.col(f"{weight}_a") * F.col(f"{weight}_b") / (F.col("d") * F.col("d"))).alias("total"))


def scopes(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Every row once for each scope it belongs to, as ``scope``; scopes may overlap."""
    hits = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda s: s.isNotNull())
    return df.withColumn("scope", F.explode(hits))


def atlas(df: DataFrame, group: list[str], key: str, scales: dict[str, Column], radii: list[float], rules: dict[str, Column], stats: dict, axes: tuple[str, ...] = XYZ) -> DataFrame:
    """Features of scale x radius x scope x statistic: ``group``, ``spec``, ``scope``, ``stat``, ``value``.

    One range join at the greatest radius serves all radii and scales; ``stats`` is name -> factory.
    """
    d = df.withColumns({f"_s{i}": F.coalesce(c, F.lit(0.0)) for i, c in enumerate(scales.values())})
    keep = tuple(f"_s{i}" for i in range(len(scales)))
    pairs = range_pairs(d, d, group, key, max(radii), axes, keep)
    sums = [F.sum(F.when(F.col("d") <= r, F.col(f"_s{i}_b"))).alias(f"v{i}_{j}") for i in range(len(scales)) for j, r in enumerate(radii)]
    point = pairs.groupBy(*group, "key_a").agg(*sums).withColumnRenamed("key_a", key)
    marked = scopes(point.join(df, [*group, key]), rules)
    specs = [F.struct(F.lit(f"{s}_R{r:g}").alias("spec"), F.col(f"v{i}_{j}").alias("v")) for i, s in enumerate(scales) for j, r in enumerate(radii)]
    long = marked.select(*group, "scope", F.explode(F.array(*specs)).alias("e")).select(*group, "scope", "e.spec", "e.v")
    wide = long.groupBy(*group, "spec", "scope").agg(*[f(F.col("v")).cast("double").alias(n) for n, f in stats.items()])
    return wide.unpivot([*group, "spec", "scope"], list(stats), "stat", "value")


# --- graphs


def edges_within(df: DataFrame, group: list[str], key: str, radius: float, axes: tuple[str, ...] = XYZ) -> DataFrame:
    """Contact edges a < b at most ``radius`` apart: ``group``, ``a``, ``b``, ``d``."""
    return range_pairs(df, df, group, key, radius, axes).where("key_a < key_b").select(*group, F.col("key_a").alias("a"), F.col("key_b").alias("b"), "d")


def patches(df: DataFrame, group: list[str], key: str, member: Column, link: float, area: Column, axes: tuple[str, ...] = XYZ) -> DataFrame:
    """Patches (connected points, links of at most ``link``) of the points that satisfy ``member``: ``group``, ``patch`` (its least key), ``n``, ``area``.

    Keys are unique over all groups. Components are found over all groups at once.
    """
    d = df.where(F.coalesce(member, F.lit(False))).withColumn("_area", area)
    comps = connected_components(edges_within(d, group, key, link, axes))
    named = d.join(comps, d[key] == comps.node, "left").withColumn("patch", F.coalesce("component", F.col(key)))
    return named.groupBy(*group, "patch").agg(F.count("*").alias("n"), F.sum("_area").alias("area"))


def patch_summary(found: DataFrame, group: list[str]) -> DataFrame:
    """Per group ``n_patches``, ``largest_n``, ``largest_area``, ``total_area``."""
    return found.groupBy(*group).agg(F.count("*").alias("n_patches"), F.max("n").alias("largest_n"), F.max("area").alias("largest_area"), F.sum("area").alias("total_area"))


def graph_stats(nodes: DataFrame, edges: DataFrame, group: list[str], key: str) -> DataFrame:
    """Per group ``n``, ``edges``, ``density``, ``mean_degree``, ``max_degree``, ``clustering`` (mean local coefficient, 0 under two neighbours).

    ``edges``: ``a`` < ``b``. Triangles are found by joining each edge pair at its node of least rank.
    """
    half = edges.select(*group, "a", "b")
    both = half.unionByName(half.select(*group, F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy(*group, F.col("a").alias(key)).agg(F.count("*").alias("degree"))
    first = half.select(*group, "a", F.col("b").alias("_x"))
    second = half.select(*group, "a", F.col("b").alias("_y"))
    wedge = first.join(second, [*group, "a"]).where("_x < _y")
    closing = half.select(*group, F.col("a").alias("_x"), F.col("b").alias("_y"))
    tri = wedge.join(closing, [*group, "_x", "_y"])
    at = tri.select(*group, F.explode(F.array("a", "_x", "_y")).alias(key)).groupBy(*group, key).agg(F.count("*").alias("triangles"))
    per = nodes.select(*group, key).join(degree, [*group, key], "left").join(at, [*group, key], "left").na.fill(0, ["degree", "triangles"])
    local = F.when(F.col("degree") > 1, 2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    n = F.count("*")
    return per.groupBy(*group).agg(
        n.alias("n"), (F.sum("degree") / 2).cast("long").alias("edges"), F.coalesce(F.try_divide(F.sum("degree"), (n * (n - 1)).cast("double")), F.lit(0.0)).alias("density"),
        F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"), F.avg(local).alias("clustering"),
    )


def interface(df: DataFrame, group: list[str], key: str, side: str, a: str, b: str, contact: float, clash: float, axes: tuple[str, ...] = XYZ) -> DataFrame:
    """Contacts between the points of two sides of each group: ``n_contacts``, ``n_a``, ``n_b`` (points in contact), ``n_clashes`` (closer than ``clash``)."""
    pairs = range_pairs(df.where(F.col(side) == a), df.where(F.col(side) == b), group, key, contact, axes)
    return pairs.groupBy(*group).agg(F.count("*").alias("n_contacts"), F.countDistinct("key_a").alias("n_a"), F.countDistinct("key_b").alias("n_b"), F.count_if(F.col("d") < clash).alias("n_clashes"))


def typed_contacts(df: DataFrame, group: list[str], key: str, kind: str, rules: list[tuple[str, str, str, float]], axes: tuple[str, ...] = XYZ) -> DataFrame:
    """Number of pairs by rule (name, kind of one, kind of the other, cutoff) in one range join: ``group``, one column a rule."""
    pairs = range_pairs(df, df, group, key, max(r[3] for r in rules), axes, (kind,)).where("key_a < key_b")
    ka, kb = F.col(f"{kind}_a"), F.col(f"{kind}_b")
    return pairs.groupBy(*group).agg(*[F.count_if((((ka == x) & (kb == y)) | ((ka == y) & (kb == x))) & (F.col("d") <= cut)).alias(n) for n, x, y, cut in rules])


def buried_unsatisfied(df: DataFrame, group: list[str], key: str, depth: str, polar: Column, partner: Column, cutoff: float, share: float = 0.15, axes: tuple[str, ...] = XYZ) -> DataFrame:
    """Points of low ``depth`` (up to the group's ``share`` quantile), ``n_buried``, and the polar ones of them without a partner within ``cutoff``, ``n_unsatisfied``."""
    q = quantiles(df, group, depth, [share]).select(*group, F.col("q")[0].alias("_q"))
    low = df.join(q, group).where(F.col(depth) <= F.col("_q"))
    met = range_pairs(low, df.where(partner), group, key, cutoff, axes).where("key_a != key_b").select(*group, F.col("key_a").alias(key)).distinct().withColumn("_met", F.lit(True))
    both = low.join(met, [*group, key], "left")
    return both.groupBy(*group).agg(F.count("*").alias("n_buried"), F.count_if(polar & F.col("_met").isNull()).alias("n_unsatisfied"))


def max_density(df: DataFrame, group: list[str], key: str, weight: Column, radius: float, axes: tuple[str, ...] = XYZ) -> DataFrame:
    """Per group the greatest neighbourhood sum: ``group``, ``density``."""
    return neighbour_sums(df, group, key, weight, radius, axes).groupBy(*group).agg(F.max("total").alias("density"))


def median_pair_distance(df: DataFrame, group: list[str], key: str, train: Column, axes: tuple[str, ...] = XYZ) -> DataFrame:
    """Median of all pair distances within the train groups: one row ``n_pairs``, ``median``."""
    d = all_distances(df.where(train), group, key, axes)
    q = quantiles(d, [], "d", [0.5])
    return d.agg(F.count("*").alias("n_pairs")).crossJoin(q.select(F.col("q")[0].alias("median")))  # one row each


def side_chain_centres(atoms: DataFrame, group: list[str], residue: str, atom: str, heavy: Column, axes: tuple[str, ...] = XYZ) -> DataFrame:
    """Mean of a residue's heavy side-chain atoms; without any its CA, else invalid: ``x``, ``y``, ``z``, ``origin``, ``n_atoms``."""
    fine = reduce(lambda s, c: s & (F.abs(c) < float("inf")), axes, F.lit(True))
    side = fine & heavy & ~F.col(atom).isin("N", "CA", "C", "O")
    ca = fine & (F.col(atom) == "CA")
    out = atoms.groupBy(*group, residue).agg(F.count_if(side).alias("n_atoms"), *[F.avg(F.when(side, F.col(c))).alias(f"_s{c}") for c in axes], *[F.avg(F.when(ca, F.col(c))).alias(f"_c{c}") for c in axes])
    origin = F.when(F.col("n_atoms") > 0, "SIDE_CHAIN").when(F.col(f"_c{axes[0]}").isNotNull(), "CA").otherwise("INVALID")
    return out.select(*group, residue, *[F.coalesce(f"_s{c}", f"_c{c}").alias(c) for c in axes], origin.alias("origin"), "n_atoms")


def rbf(distance: Column | str, centres: list[float], sigma: float) -> Column:
    """Gaussian kernels of a distance: one entry a centre."""
    d = F.col(distance) if isinstance(distance, str) else distance
    return F.array(*[F.exp(-((d - F.lit(float(c))) ** 2) / (2 * sigma * sigma)) for c in centres])


# --- surfaces


def sphere_points(n: Column) -> Column:
    """``n`` evenly spread unit vectors (Fibonacci lattice): array of structs x, y, z."""
    golden = np.pi * (3 - np.sqrt(5))

    def at(i: Column) -> Column:
        z = 1 - (2 * i + 1) / n
        r = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z))
        return F.struct((r * F.cos(i * golden)).alias("x"), (r * F.sin(i * golden)).alias("y"), z.alias("z"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), at)).otherwise(F.array().cast("array<struct<x:double,y:double,z:double>>"))


def surface_points(atoms: DataFrame, group: list[str], key: str, surface: str, size: str, per_area: float = 0.35, most: int | None = 2000) -> DataFrame:
    """Points on the atoms' spheres that lie outside all other atoms: ``group``, ``key``, ``point``, x, y, z.

    round(surface * ``per_area``) points an atom. ``most`` points a group are kept at even
    steps, as the sampling asks for; None keeps all.
    """
    on = atoms.withColumn("_p", F.explode(sphere_points(F.round(F.col(surface) * per_area))))
    pts = on.select(*group, F.col(key), *[(F.col(c) + F.col(size) * F.col(f"_p.{c}")).alias(c) for c in XYZ], F.monotonically_increasing_id().alias("_m"))
    # numbered by place, not by partition, so that a lost task changes nothing
    pts = pts.withColumn("point", F.xxhash64(*group, key, *XYZ)).drop("_m")
    reach = atoms.agg(F.max(size)).first()[0] or 1.0
    inside = range_pairs(pts.withColumn("_own", F.col(key).cast("string")).withColumn("_size", F.lit(0.0)), atoms.withColumn("_own", F.col(key).cast("string")).withColumn("_size", F.col(size)).withColumn("point", F.lit(0).cast("long")), group, "point", reach, keep=("_own", "_size"))
    hidden = inside.where((F.col("_own_a") != F.col("_own_b")) & (F.col("d") < F.col("_size_b") - 1e-9)).select(*group, F.col("key_a").alias("point")).distinct()
    out = pts.join(hidden, [*group, "point"], "left_anti")
    if most is None:
        return out
    from pyspark.sql import Window

    w = Window.partitionBy(*group)
    ranked = out.withColumns({"_r": F.row_number().over(w.orderBy(key, "point")) - 1, "_n": F.count("*").over(w)})
    step = lambda r: F.floor(r * most / F.col("_n"))
    return ranked.where((F.col("_n") <= most) | (F.col("_r") == 0) | (step(F.col("_r")) != step(F.col("_r") - 1))).drop("_r", "_n")


def surface_summary(df: DataFrame, group: list[str], value: str, area: str, high: float) -> DataFrame:
    """Area-weighted mean, q75, q90, q95, top-10% mean and area shares of a field: ``wmean``, ``q75``, ``q90``, ``q95``, ``top_mean``, ``positive_area``, ``high_area``."""
    from chainloom.operators.aggregate import weighted_mean

    q = quantiles(df, group, value, [0.75, 0.9, 0.95])
    both = df.join(q, group)
    return both.groupBy(*group).agg(
        weighted_mean(area, value).alias("wmean"), F.first(F.col("q")[0]).alias("q75"), F.first(F.col("q")[1]).alias("q90"), F.first(F.col("q")[2]).alias("q95"),
        F.avg(F.when(F.col(value) >= F.col("q")[1], F.col(value))).alias("top_mean"),
        F.try_divide(F.sum(F.when(F.col(value) > 0, F.col(area)).otherwise(0.0)), F.sum(area)).alias("positive_area"), F.try_divide(F.sum(F.when(F.col(value) > high, F.col(area)).otherwise(0.0)), F.sum(area)).alias("high_area"),
    )


def co_fields(df: DataFrame, group: list[str], a: str, b: str, area: str) -> DataFrame:
    """Two fields on one surface: ``n``, ``pearson`` and the area shares where a > 0 and b > 0, < 0."""
    from chainloom.operators.stats import pearson

    share = lambda c: F.try_divide(F.sum(F.when(c, F.col(area)).otherwise(0.0)), F.sum(area))
    return df.groupBy(*group).agg(F.count("*").alias("n"), pearson(a, b).alias("pearson"), share((F.col(a) > 0) & (F.col(b) > 0)).alias("both_positive"), share((F.col(a) > 0) & (F.col(b) < 0)).alias("opposed"))


def sample_grid(points: DataFrame, grid: DataFrame, group: list[str], origin: tuple[float, float, float], step: tuple[float, float, float], axes: tuple[str, ...] = XYZ) -> DataFrame:
    """The grid's value in the cell whose lower corner is next below each point; points outside are left out. ``grid``: ``group``, i, j, k, ``value``."""
    at = [F.floor((F.col(c) - o) / s).cast("long").alias(n) for c, o, s, n in zip(axes, origin, step, "ijk")]
    return points.select("*", *at).join(grid, [*group, "i", "j", "k"])


# --- ensembles of structures


def kabsch(a: np.ndarray, b: np.ndarray) -> float:
    """Least RMSD of two point sets of equal length under rotation and shift."""
    a, b = a - a.mean(0), b - b.mean(0)
    u, s, vt = np.linalg.svd(a.T @ b)
    s[-1] *= np.sign(np.linalg.det(u @ vt))
    return float(np.sqrt(max(0.0, ((a**2).sum() + (b**2).sum() - 2 * s.sum()) / len(a))))


def superposed_rmsd(df: DataFrame, group: list[str], member: str, position: str, axes: tuple[str, ...] = XYZ, least: int = 5) -> DataFrame:
    """RMSD after superposition of every two members (a < b) of a group: ``group``, ``a``, ``b``, ``n``, ``rmsd``.

    The first min(length) points by ``position`` are compared; null under ``least`` of
    them. A member's points are one array; pairs of members are spread over tasks.
    """
    packed = df.groupBy(*group, member).agg(F.transform(F.sort_array(F.collect_list(F.struct(position, *axes))), lambda s: F.array(*[s[c].cast("double") for c in axes])).alias("p"))
    a = packed.select(*group, F.col(member).alias("a"), F.flatten("p").alias("pa"))
    b = packed.select(*group, F.col(member).alias("b"), F.flatten("p").alias("pb"))
    d = len(axes)

    @F.pandas_udf("double")
    def rmsd(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            out = []
            for p, q in zip(x, y):
                n = min(len(p), len(q)) // d * d
                out.append(kabsch(np.asarray(p[:n], float).reshape(-1, d), np.asarray(q[:n], float).reshape(-1, d)) if n >= least * d else None)
            yield pd.Series(out, dtype="float64")

    return a.join(b, group).where("a < b").select(*group, "a", "b", (F.least(F.size("pa"), F.size("pb")) / d).cast("int").alias("n"), rmsd("pa", "pb").alias("rmsd"))


def disagreement(pairs: DataFrame, group: list[str], value: str = "rmsd") -> DataFrame:
    """Median, maximum and population sd of pairwise values of a group."""
    return pairs.groupBy(*group).agg(F.count(value).alias("n_pairs"), F.median(value).alias("median"), F.max(value).alias("max"), F.stddev_pop(value).alias("sd"))


def contact_occupancy(df: DataFrame, group: list[str], frame: str, key: str, cutoff: float, separation: int = 3, axes: tuple[str, ...] = XYZ) -> DataFrame:
    """Contacts over the frames of an ensemble: ``n_pairs`` ever in contact, ``persistent`` (occupancy >= 0.9), ``labile`` (0.1 .. 0.9), ``entropy`` (mean Bernoulli entropy)."""
    from chainloom.operators.aggregate import bernoulli_entropy

    frames = df.groupBy(*group).agg(F.countDistinct(frame).alias("_frames"))
    near = range_pairs(df, df, [*group, frame], key, cutoff, axes).where(F.col("key_b") - F.col("key_a") >= separation)
    occ = near.groupBy(*group, "key_a", "key_b").agg(F.count("*").alias("_n")).join(frames, group).withColumn("p", F.col("_n") / F.col("_frames"))
    return occ.groupBy(*group).agg(F.count("*").alias("n_pairs"), F.avg((F.col("p") >= 0.9).cast("double")).alias("persistent"), F.avg(((F.col("p") > 0.1) & (F.col("p") < 0.9)).cast("double")).alias("labile"), bernoulli_entropy(F.col("p")).alias("entropy"))


def fluctuation(df: DataFrame, group: list[str], key: str, axes: tuple[str, ...] = XYZ) -> DataFrame:
    """Root mean square deviation of each point from its mean place over the frames (already superposed): ``group``, ``key``, ``rmsf``."""
    return df.groupBy(*group, key).agg(F.sqrt(reduce(lambda s, c: s + F.var_pop(c), axes, F.lit(0.0))).alias("rmsf"))


# --- pooling


def pooled(df: DataFrame, by: list[str], vector: str, weight: Column | None = None, empty: float | None = 0.0, width: int | None = None) -> DataFrame:
    """Weighted mean of vectors by group: ``by``, ``weight``, ``pooled``.

    Vectors of another length, null vectors and weights that aren't positive don't count.
    A group without any gets ``empty`` in each of ``width`` places (null if None).
    Sums are taken place by place and combined before the shuffle.
    """
    w = F.coalesce(weight, F.lit(0.0)) if weight is not None else F.lit(1.0)
    rows = df.select(*by, w.cast("double").alias("_w"), F.col(vector).alias("_v"))
    good = rows.where((F.col("_w") > 0) & F.col("_v").isNotNull() & (F.size("_v") == width if width else F.lit(True)))
    cells = good.select(*by, "_w", F.posexplode("_v").alias("_i", "_x")).groupBy(*by, "_i").agg((F.sum(F.col("_w") * F.col("_x").cast("double")) / F.sum("_w")).alias("_m"), F.sum("_w").alias("_sw"))
    packed = cells.groupBy(*by).agg(F.first("_sw").alias("weight"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("pooled"))
    if width is None:
        return packed
    every = rows.select(*by).distinct()
    filler = F.array_repeat(F.lit(empty).cast("double"), width) if empty is not None else F.lit(None).cast("array<double>")
    return every.join(packed, by, "left").select(*by, F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("pooled", filler).alias("pooled"))


def upper_distances(df: DataFrame, key: str, vector: str, member: str) -> DataFrame:
    """Distances of all pairs of keys within each member's geometry: ``member``, ``key_a``, ``key_b``, ``d``; for the few entities of a comparison."""
    from chainloom.functions.numbers import distance2

    a = df.select(member, F.col(key).alias("key_a"), F.col(vector).alias("_a"))
    b = df.select(member, F.col(key).alias("key_b"), F.col(vector).alias("_b"))
    return a.join(b, member).where("key_a < key_b").select(member, "key_a", "key_b", F.sqrt(distance2("_a", "_b")).alias("d"))


# --- similarity of texts


#: By the places that may differ, the groups formed beyond their number and one; this only sets how many false candidates meet.
_SPARE = {1: 5, 2: 3, 3: 2, 4: 1, 5: 1, 6: 1}
#: Texts up to this length are listed by groups of places, longer ones by blocks; either way no pair is missed.
_GROUPED = 64


def _kept_places(width: int, differ: int, spread: dict[int, float]) -> list[list[int]]:
    """The places of texts of ``width`` letters in groups of like ``spread``: those left for each way to leave out ``differ`` groups."""
    many = min(width, differ + 1 + _SPARE.get(differ, 0))
    groups: list[list[int]] = [[] for _ in range(many)]
    load = [0.0] * many
    for place in sorted(range(width), key=lambda i: (-spread.get(i, 0.0), i)):
        g = min(range(many), key=lambda j: (load[j], len(groups[j]), j))
        groups[g].append(place)
        load[g] += spread.get(place, 0.0)
    return [sorted(i for g, own in enumerate(groups) if g not in gone for i in own) for gone in combinations(range(many), differ)]


def _listings(lengths: dict[int, int], spread: dict[int, float]):
    """Rows of each text ``_t``: for every length ``n`` of the longer text that it may meet, the letters ``s`` of each choice ``i`` of groups; ``lengths``: how many places may differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {n: _kept_places(n, differ, spread) for n, differ in lengths.items()}
        for batch in batches:
            rows = []
            for t in batch.column("_t").to_pylist():
                for n, choices in kept.items():
                    if n - lengths[n] <= len(t) <= n:
                        rows += [(n, i, "".join(t[x] for x in places if x < len(t)), t) for i, places in enumerate(choices)]
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.string()))], names=["n", "i", "s", "_t"])

    return run


def _met_by_groups(classes: DataFrame, longest: int, threshold: float) -> DataFrame:
    """Candidate pairs ``_t``, ``_u`` of texts up to ``longest`` letters, as :func:`similar_texts` has it."""
    lengths = {n: m for n in range(1, longest + 1) if (m := int((1 - threshold) * n + 1e-9))}  # texts that may not differ are equal
    letters = classes.select(F.posexplode(F.split("_t", "")).alias("i", "c")).where("c != ''").groupBy("i", "c").count()
    spread = {r.i: r.w for r in letters.groupBy("i").agg((F.log2(F.sum("count")) - F.sum(F.col("count") * F.log2("count")) / F.sum("count")).alias("w")).collect()}
    listed = classes.mapInArrow(_listings(lengths, spread), "n int, i int, s string, _t string")
    other = listed.withColumnRenamed("_t", "_u")
    return listed.where("length(_t) = n").join(other, ["n", "i", "s"]).where("length(_u) < n or _t < _u").select("_t", "_u").distinct()


def _met_by_blocks(classes: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs ``_t``, ``_u`` that share a block of w < 1 / (1 - threshold) places: there are more blocks than differences."""
    width = max(1, int(np.ceil(1 / (1 - threshold) - 1e-9)) - 1)
    blocks = classes.select("_t", F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.length("_t") / width).cast("int") - 1), lambda i: F.struct(i.alias("i"), F.substring(F.col("_t"), i * width + 1, F.lit(width)).alias("s")))).alias("b")).select("_t", "b.i", "b.s")
    other = blocks.withColumnRenamed("_t", "_u")
    return blocks.join(other, ["i", "s"]).where("_t < _u").select("_t", "_u").distinct()


def similar_texts(df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """Pairs of keys (a < b) whose positional identity reaches ``threshold`` (below 1): ``a``, ``b``, ``identity``.

    A pair of n letters, the longer length, differs at m = (1 - threshold) n places at
    most, those beyond the shorter text included. The places are parted into more than m
    groups; as at most m of them hold a difference, some choice of all but m groups is the
    same in both: an equi-join on these finds every pair. Groups get about equally many
    different letters, so that a beginning all texts share makes no candidates.
    Equal texts are one class and are expanded at the end. Null and empty texts are in no pair.
    """
    from chainloom.functions.text import positional_identity

    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    known = df.where((F.length(text) > 0) & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("_t")).distinct()
    classes = known.select("_t").distinct()
    longest = classes.agg(F.max(F.length("_t"))).first()[0] or 0
    met = _met_by_groups(classes, longest, threshold) if longest <= _GROUPED else _met_by_blocks(classes, threshold)
    pairs = met.withColumn("identity", positional_identity("_t", "_u")).where(F.col("identity") >= threshold)
    a, b = known.select(F.col("_k").alias("_ka"), "_t"), known.select(F.col("_k").alias("_kb"), F.col("_t").alias("_u"))
    across = pairs.join(a, "_t").join(b, "_u").where("_ka != _kb").select(F.least("_ka", "_kb").alias("a"), F.greatest("_ka", "_kb").alias("b"), "identity")
    same = known.join(known.select(F.col("_k").alias("_kb"), "_t"), "_t").where("_k < _kb").select(F.col("_k").alias("a"), F.col("_kb").alias("b"), F.lit(1.0).alias("identity"))
    every = across.unionByName(same)
    if known.groupBy("_k").count().where("count > 1").isEmpty():
        return every  # a key has one text, so a pair comes once
    return every.groupBy("a", "b").agg(F.max("identity").alias("identity"))


def nearest_reference(queries: DataFrame, rows: DataFrame, key: str, text: str, most_queries: int = 20_000) -> DataFrame:
    """For each query text the most similar row (ties to the least key): ``query``, ``nearest``, ``identity``.

    A stated query set against all rows, in blocks: at most ``most_queries`` distinct
    query texts are broadcast at a time, every row meets a block once, and each task keeps
    one row a query.
    """
    from chainloom.functions.text import positional_identity

    q = queries.where(F.length(text) > 0).select(F.col(text).alias("_q")).distinct()
    blocks = max(1, -(-q.count() // most_queries))
    r = rows.where(F.length(text) > 0).groupBy(F.col(text).alias("_t")).agg(F.min(key).alias("_k"))
    found = None
    for i in range(blocks):
        part = q.where(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == i)
        best = r.crossJoin(F.broadcast(part)).groupBy("_q").agg(F.max(F.struct(positional_identity("_q", "_t").alias("s"), (-F.col("_k")).alias("k"))).alias("_b"))
        found = best if found is None else found.unionByName(best)
    named = queries.select(F.col(key).alias("query"), F.col(text).alias("_q"))
    return named.join(found, "_q").select("query", (-F.col("_b.k")).alias("nearest"), F.col("_b.s").alias("identity"))
