"""Splits that keep related records together (problem 2).

Records that share a key form components. Components of equal size and label profile are
bundled. A flow from the bundles over their labels to the splits is priced by the squared
deviation of the splits' records and label records from their quotas. Its fractional
optimum is the proportional one, of cost 0; it is rounded down, the components left over
take the cheapest path, and negative cycles over all bundles (a move, an exchange of two
bundles, a ring of three) are cancelled until there is none. A bundle's components are
dealt out in hash order. The driver sees only the bundles.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.chains import antibody, residues
from chainloom.operators.components import connected_components
from chainloom.operators.prefix import order_hash, prefix_sum
from chainloom.session import stage


def shared_keys(dev: DataFrame) -> DataFrame:
    """``id``, ``key``: a 128-bit key each for the antibody of the id, the heavy and the light residues."""
    kinds = {"i": antibody("id"), "h": F.nullif(residues("heavy"), F.lit("")), "l": F.nullif(residues("light"), F.lit(""))}
    keys = F.array(*[F.when(v.isNotNull(), F.unhex(F.md5(F.concat(F.lit(k), v)))) for k, v in kinds.items()])
    return dev.where("id is not null").select("id", F.explode(keys).alias("key")).where("key is not null")


def related(dev: DataFrame, label: str = "source") -> DataFrame:
    """``id``, ``component`` (its smallest id), ``linked`` and ``label`` of every dev id.

    Repeated rows of an id count once; conflicting rows of one id contribute all their
    keys. Null ids are left out. Empty chains link nothing.
    """
    keyed = shared_keys(dev)
    # the key's own 16 bytes under another expression: shuffled anew, the join can split a key that many records share
    least = keyed.groupBy("key").agg(F.min("id").alias("_m"), F.max("id").alias("_x")).where("_m != _x").select(F.substring("key", 1, 16).alias("key"), F.col("_m"))
    edges = keyed.join(least, "key").where("id != _m").select(F.col("id").alias("a"), F.col("_m").alias("b"))
    comps = connected_components(edges)
    ids = dev.where("id is not null").groupBy("id").agg(F.min(label).alias("label"))
    return ids.join(comps, ids.id == comps.node, "left").select("id", F.coalesce("component", "id").alias("component"), F.col("component").isNotNull().alias("linked"), "label")


def _move_costs(sizes, profiles, weight, off, off_label):
    """Added cost of moving one component of bundle b from split s to split t, as an array [b, s, t]."""
    gap = off[None, :] - off[:, None]
    along = profiles @ off_label.T  # [b, s]
    whole = sizes[:, None, None] * (sizes[:, None, None] + gap[None])
    part = (profiles**2).sum(1)[:, None, None] + along[:, None, :] - along[:, :, None]
    return 2 * weight * whole + 2 * part


def flow_cost(sizes, profiles, flow, part) -> float:
    """Squared deviations of a flow [b, s] from the quotas ``part``, the splits' records weighted by labels + 1."""
    weight = profiles.shape[1] + 1.0
    records, labels = sizes @ flow, profiles.T @ flow
    return float(weight * ((records - part * records.sum()) ** 2).sum() + ((labels - labels.sum(1, keepdims=True) * part[None]) ** 2).sum())


def allocate(sizes: np.ndarray, profiles: np.ndarray, counts: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Whole numbers [b, s] of components of each bundle for each split.

    ``sizes`` [b], ``profiles`` [b, label] (records of each label in one component),
    ``counts`` [b], ``part`` [s] (shares that sum to 1). Cost and method as in the
    module's text. Ties go to the first split and bundle.
    """
    sizes, profiles, part = np.asarray(sizes, float), np.asarray(profiles, float), np.asarray(part, float)
    counts = np.asarray(counts, np.int64)
    weight, n_splits = profiles.shape[1] + 1.0, len(part)
    flow = np.floor(counts[:, None] * part[None] + 1e-9).astype(np.int64)
    off = sizes @ flow - part * (sizes @ counts)
    off_label = flow.T @ profiles - part[:, None] * (counts @ profiles)[None]
    usable = np.flatnonzero(part > 0)

    def put(b: int, s: int, n: int = 1) -> None:
        flow[b, s] += n
        off[s] += n * sizes[b]
        off_label[s] += n * profiles[b]

    for b in np.argsort(-sizes, kind="stable"):
        for _ in range(int(counts[b] - flow[b].sum())):
            added = weight * sizes[b] * (2 * off + sizes[b]) + (profiles[b] * (2 * off_label + profiles[b])).sum(1)
            put(b, int(usable[np.argmin(np.round(added[usable], 9))]))
    arcs = [(s, t) for s in usable for t in usable if s != t]
    rings = [(s, t, u) for s in usable for t in usable for u in usable if s < t and s < u and t != u]
    points = np.concatenate([math.sqrt(weight) * sizes[:, None], profiles], axis=1)
    while True:  # every step lowers the cost, and there are finitely many flows
        m = _move_costs(sizes, profiles, weight, off, off_label)
        gaps = np.concatenate([math.sqrt(weight) * off[:, None], off_label], axis=1)
        has = [np.flatnonzero(flow[:, s] > 0) for s in range(n_splits)]
        best, steps = -1e-6, None
        for s, t in arcs:
            if len(has[s]) and (price := m[has[s], s, t]).min() < best:
                best, steps = price.min(), [(has[s][price.argmin()], s, t)]
        for s, t in arcs:
            if s < t and (found := _exchange(points, has[s], has[t], gaps[t] - gaps[s], best)):
                best, x, y = found
                steps = [(x, s, t), (y, t, s)]
        if steps is None:
            for s, t, u in rings:
                if found := _ring(points, (has[s], has[t], has[u]), gaps[[s, t, u]], best):
                    best, x, y, z = found
                    steps = [(x, s, t), (y, t, u), (z, u, s)]
        if steps is None:
            return flow
        for b, s, t in steps:
            put(b, s, -1)
            put(b, t)


def _exchange(points, xs, ys, gap, best: float):
    """Cheapest exchange of a bundle of ``xs`` for one of ``ys`` that costs less than ``best``: its cost and both; None if there is none.

    The cost is 2 |x - y + gap / 2|^2 - |gap|^2 / 2: only bundles whose sizes let that be so small are compared.
    """
    low, out = gap @ gap / 2, None
    if best + low <= 0:
        return None
    xs, ys = xs[np.argsort(points[xs, 0], kind="stable")], ys[np.argsort(points[ys, 0], kind="stable")]
    for at in range(0, len(xs), 256):
        some = xs[at : at + 256]
        far = math.sqrt(max(0.0, (best + low) / 2)) + 1e-6
        place = points[some, 0] + gap[0] / 2
        here = ys[np.searchsorted(points[ys, 0], place[0] - far) : np.searchsorted(points[ys, 0], place[-1] + far, side="right")]
        if not len(here):
            continue
        x, y = points[some] + gap / 2, points[here]
        cost = 2 * ((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T) - low
        i, j = np.unravel_index(np.argmin(cost), cost.shape)
        if cost[i, j] < best:
            best, out = cost[i, j], (cost[i, j], some[i], here[j])
    return out


def _ring(points, groups, gaps, best: float):
    """Cheapest ring (x from the first split to the second, y from there to the third, z back) that costs less than ``best``; None if there is none.

    The three splits' squared deviations afterwards add up to the cost and what they are
    now, so each alone must be below that sum.
    """
    now = (gaps**2).sum()
    x, z, out = points[groups[0]], points[groups[2]], None
    if not all(map(len, groups)):
        return None
    for b in groups[1]:
        dx, dz = ((gaps[1] + x - points[b]) ** 2).sum(1), ((gaps[2] + points[b] - z) ** 2).sum(1)
        i, k = np.flatnonzero(dx < now + best), np.flatnonzero(dz < now + best)
        for at in range(0, len(i), 256):
            rows = i[at : at + 256]
            if not len(k):
                break
            p, q = x[rows] - gaps[0], z[k]
            cost = dx[rows][:, None] + dz[k][None] + (p**2).sum(1)[:, None] + (q**2).sum(1)[None] - 2 * p @ q.T - now
            n, o = np.unravel_index(np.argmin(cost), cost.shape)
            if cost[n, o] < best:
                best, out = cost[n, o], (cost[n, o], groups[0][rows[n]], b, groups[2][k[o]])
    return out


def _bundled(sized: DataFrame) -> tuple[DataFrame, list]:
    """Components with their ``profile`` (sorted label = records), and the bundles, whatever their number."""
    profile = F.transform(F.array_sort("counts"), lambda c: F.concat(F.coalesce(c["label"], F.lit("\x00")), F.lit("\x01"), c["n"].cast("string")))
    comps = sized.select("component", "size", F.array_join(profile, "\x02").alias("profile"))
    rows = comps.groupBy("size", "profile").agg(F.count("*").alias("n")).collect()
    return comps, sorted(rows, key=lambda r: (r["size"], r["profile"]))


def split_records(dev: DataFrame, split_target: DataFrame, label: str = "source", seed: int = 0) -> DataFrame:
    """``id``, ``component``, ``linked``, ``split`` of every dev id; a component never straddles splits.

    Shares are scaled to sum 1, null or negative ones count as 0. Ties are settled by
    hash and id. Without a usable share, or without rows, the result is empty.
    """
    recs = stage(related(dev, label), "related")
    per = recs.groupBy("component", F.col("label").cast("string").alias("label")).agg(F.count("*").alias("n"))
    sized = per.groupBy("component").agg(F.sum("n").alias("size"), F.collect_list(F.struct("label", "n")).alias("counts"))  # a component has few labels
    comps, bundles = _bundled(sized)
    shares = [(r.split_name, max(0.0, r.share or 0.0)) for r in split_target.groupBy("split_name").agg(F.sum("share").alias("share")).orderBy("split_name").collect()]
    lines: list[tuple] = []
    total = sum(w for _, w in shares)
    if total > 0 and bundles:
        mixes = [dict(e.split("\x01") for e in r["profile"].split("\x02")) for r in bundles]
        place = {name: i for i, name in enumerate(sorted({k for mix in mixes for k in mix}))}
        profiles = np.zeros((len(bundles), len(place)))
        for i, mix in enumerate(mixes):
            for k, n in mix.items():
                profiles[i, place[k]] = int(n)
        flow = allocate(np.array([r["size"] for r in bundles]), profiles, np.array([r["n"] for r in bundles]), np.array([w / total for _, w in shares]))
        for r, counts in zip(bundles, flow.tolist()):
            first = 0
            for (split, _), n in zip(shares, counts):
                lines += [(r["size"], r["profile"], first, first + n, split)] * (n > 0)
                first += n
    cuts = recs.sparkSession.createDataFrame(lines, "_size long, _profile string, _from long, _to long, split string")
    ranked = prefix_sum(comps.withColumn("_h", order_hash("component", seed=seed)).withColumn("_one", F.lit(1)), ["size", "profile"], "_h", ["component"], "_one", "_rank")
    here = (F.col("size") == F.col("_size")) & (F.col("profile") == F.col("_profile")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    # a row for each bundle and split, checked before broadcasting
    dealt = ranked.join(F.broadcast(cuts) if len(lines) <= 100_000 else cuts, here).select("component", "split")
    return recs.join(dealt, "component").select("id", "component", "linked", "split")


def bound_pairs(split: DataFrame) -> DataFrame:
    """All pairs of ids that share a component, and so a split: ``id_a`` < ``id_b``."""
    rows = split.where("linked").select("id", "component", "split")
    a = rows.select(F.col("id").alias("id_a"), "component", "split")
    b = rows.select(F.col("id").alias("id_b"), "component", "split")
    return a.join(b, ["component", "split"]).where("id_a < id_b").select("id_a", "id_b")


def split_report(split: DataFrame, split_target: DataFrame) -> DataFrame:
    """``split_name``, target ``share``, ``n_records``, ``n_components`` and ``reached`` share."""
    got = split.groupBy(F.col("split").alias("split_name")).agg(F.count("*").alias("n_records"), F.countDistinct("component").alias("n_components"))
    every = got.agg(F.sum("n_records").alias("_n"))
    joined = split_target.select("split_name", "share").join(got, "split_name", "left").join(F.broadcast(every))  # one row
    return joined.select("split_name", "share", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_components", F.lit(0)).alias("n_components"), F.coalesce(F.try_divide("n_records", "_n"), F.lit(0.0)).alias("reached"))
