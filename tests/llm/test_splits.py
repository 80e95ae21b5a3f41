import itertools

import numpy as np
from pyspark.sql import functions as F

from chainloom.llm.splits import allocate, bound_pairs, flow_cost, split_records, split_report

DEV = "id string, heavy string, light string, source string"


def every_flow(counts, splits):
    def deal(n):
        return [c for c in itertools.product(range(n + 1), repeat=splits) if sum(c) == n]

    return itertools.product(*[deal(n) for n in counts])


def test_flow_against_exhaustive_search():
    rng = np.random.default_rng(4)
    worse, gaps = [], []
    for _ in range(60):
        b = int(rng.integers(1, 4))
        profiles = rng.integers(0, 4, (b, 2))
        profiles[:, 0] += profiles.sum(1) == 0
        counts = rng.integers(1, 5, b)
        part = rng.dirichlet(np.ones(3))
        sizes = profiles.sum(1)
        got = flow_cost(sizes, profiles, allocate(sizes, profiles, counts, part), part)
        best = min(flow_cost(sizes, profiles, np.array(f), part) for f in every_flow(counts, 3))
        worse.append(got > best + 1e-6)
        gaps.append(got - best)
    print(np.mean(worse), max(gaps))
    assert np.mean(worse) <= 0.1 and max(gaps) <= 30


def test_flow_sends_every_component_once_and_none_to_empty_shares():
    flow = allocate(np.array([1, 3]), np.array([[1.0], [3.0]]), np.array([100, 7]), np.array([0.8, 0.2, 0.0]))
    assert flow.sum(1).tolist() == [100, 7] and flow[:, 2].sum() == 0


def test_records_of_a_component_share_a_split(spark):
    rows = [(f"AB-{i}", f"H{'ACDEFGHIKL'[i % 10]}{i // 20}", f"L{'ACDEFGHIKLMNPQRSTVWY'[i % 20]}{i}" if i % 7 else None, None if i % 11 == 0 else f"s{i % 3}") for i in range(200)] + [("ab 3 (dup)", "", "", "x"), (None, "AA", "CC", "x"), ("zz", None, None, None)]
    dev = spark.createDataFrame(rows + rows[:5], DEV).withColumn("split", F.lit("clash"))
    target = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), ("none", None)], "split_name string, share double")
    out = split_records(dev, target).collect()
    assert len(out) == len({r.id for r in out}) == 202
    by = {}
    for r in out:
        by.setdefault(r.component, set()).add(r.split)
    assert all(len(v) == 1 for v in by.values()) and all(r.split != "none" for r in out)
    assert len({r.component for r in out if r.id in ("AB-3", "ab 3 (dup)")}) == 1
    split = split_records(dev, target)
    pairs = bound_pairs(split).count()
    linked = {}
    for r in out:
        linked[r.component] = linked.get(r.component, 0) + 1
    assert pairs == sum(n * (n - 1) // 2 for n in linked.values())
    assert {r.split_name for r in split_report(split, target).collect()} == {"train", "validation", "test", "none"}


def test_empty_tables(spark):
    target = spark.createDataFrame([("train", 1.0)], "split_name string, share double")
    assert split_records(spark.createDataFrame([], DEV), target).count() == 0
    one = spark.createDataFrame([("A1", "AA", "CC", None)], DEV)
    assert split_records(one, target.limit(0)).count() == 0
    assert split_records(one, target).collect()[0].split == "train"


def test_splits_do_not_depend_on_the_number_of_bundles(spark, monkeypatch):
    from chainloom.llm import splits

    dev = spark.createDataFrame([(f"AB-{i}", f"H{i // 3}" if i % 5 else f"X{i}", None, f"s{i * i % 7 % 4}") for i in range(240)], DEV).withColumn("heavy", F.translate("heavy", "0123456789", "ACDEFGHIKL"))
    target = spark.createDataFrame([("train", 0.7), ("validation", 0.2), ("test", 0.1)], "split_name string, share double")
    rows = lambda: sorted(map(tuple, split_records(dev, target).select("id", "split").collect()))
    want = rows()
    monkeypatch.setattr(splits, "MOST_BUNDLES", 3, raising=False)
    monkeypatch.setattr(splits, "_TRIED", 1, raising=False)
    assert rows() == want


def test_no_exchange_of_many_bundles_is_left_out():
    rng = np.random.default_rng(6)
    profiles = rng.integers(0, 40, (700, 3)).astype(float)
    profiles[:, 0] += 1
    part, sizes = np.array([0.7, 0.2, 0.1]), profiles.sum(1)
    flow = allocate(sizes, profiles, np.ones(700, int), part)
    points = np.concatenate([2 * sizes[:, None], profiles], axis=1)
    off = flow.T @ points - part[:, None] * points.sum(0)
    for s, t in itertools.combinations(range(3), 2):
        x, y = points[flow[:, s] > 0], points[flow[:, t] > 0]
        d = y[None] - x[:, None]
        cost = ((off[s] + d) ** 2).sum(-1) + ((off[t] - d) ** 2).sum(-1) - (off[s] ** 2).sum() - (off[t] ** 2).sum()
        assert cost.min() > -1e-3
