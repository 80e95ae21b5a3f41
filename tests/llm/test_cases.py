"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import random
from datetime import datetime as dt

from chainloom.llm import clusters, encode, lookalike, mixing, neardup, overlap, similar, splits

LETTERS = "ACDEFGHIKLMNPQRSTVWY"
CLASH = ("k", "x", "y", "n", "d", "t", "h", "v", "c", "r", "a", "b", "node", "component", "label", "split", "cell", "leader", "size", "key", "count")
DEV = "id string, heavy string, light string, source string, delivered_at timestamp"
FOLDS = "scheme string, id string, fold int, assigned_at timestamp"
VECTORS = "ids string, ablang2__HL_paired array<float>, extracted_at timestamp"
TARGET = "split_name string, share double"


def text(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(LETTERS) for _ in range(n))


def dev_rows():
    a, b, long = text(120, 1), text(110, 2), text(20_000, 3)
    edited = long[:500] + "W" + long[501:9000] + long[9001:]
    return [
        ("AB-1", a, b, "s", dt(2024, 1, 1)), ("AB-1", a, b, "s", dt(2024, 1, 1)), ("AB-2", b, a, None, None), ("AB-3", a[:50] + "W" + a[50:], b, "s", None), ("cd 9", a.lower(), f" {b[:30]}-{b[30:]} ", "t", None),
        ("none", None, None, None, None), ("blank", "", " ", "s", None), ("odd", "123", "日本", "s", None), (None, a, b, "s", None), ("half", a, None, "s", None), ("Long-1", long, None, "s", None), ("Long-2", None, edited, "s", None), ("E-7", "AC", "D", "s", None), ("E-8", "AC", "D", "s", None),
    ]


def dev(spark, rows=None):
    return spark.createDataFrame(dev_rows() if rows is None else rows, DEV).selectExpr("*", *[f"1 as `{c}`" for c in CLASH])


NEAR = {("AB-1", "AB-2"), ("AB-1", "AB-3"), ("AB-2", "AB-3"), ("AB-1", "cd 9"), ("AB-2", "cd 9"), ("AB-3", "cd 9"), ("Long-1", "Long-2"), ("E-7", "E-8")}


def test_near_duplicates(spark):
    got = [tuple(r) for r in neardup.near_pairs(dev(spark)).collect()]
    assert set(got) == NEAR and len(got) == len(NEAR)
    groups = {r.id: r.group_id for r in neardup.near_groups(dev(spark)).collect()}
    assert len({groups[i] for i in ("AB-1", "AB-2", "AB-3", "cd 9")}) == 1 and "none" not in groups and "blank" not in groups
    assert neardup.near_pairs(dev(spark, [])).count() == 0 and neardup.near_groups(dev(spark, [])).count() == 0


def test_overlaps(spark):
    folds = [("p", "AB-1", 0, dt(2024, 1, 1)), ("p", "AB-1", 1, dt(2024, 1, 2)), ("p", "AB-1", 1, dt(2024, 1, 2)), ("p", " AB-2 ", 2, None), ("p", "AB-3", None, None), ("p", "E-7", 1, None), ("p", "E-8", 1, None), ("q", "E-7", 0, None), ("q", "E-8", 3, None), ("q", "missing", 1, None), (None, "AB-1", 1, None), ("q", None, 1, None)]
    f = spark.createDataFrame(folds, FOLDS).selectExpr("*", *[f"1 as `{c}`" for c in CLASH])
    found = overlap.cross_split(dev(spark), f)
    assert {tuple(r) for r in found.collect()} == {("p", "AB-1", "AB-2", 1, 2), ("q", "E-7", "E-8", 0, 3)}
    counts = {(r.scheme, r.fold, r.source): (r.n_pairs, r.n_records) for r in overlap.overlap_counts(found, dev(spark)).collect()}
    assert counts == {("p", 1, "s"): (1, 1), ("p", 2, None): (1, 1), ("q", 0, "s"): (1, 1), ("q", 3, "s"): (1, 1)}
    for d, g in ((dev(spark, []), f), (dev(spark), f.limit(0))):
        assert overlap.cross_split(d, g).count() == 0 and overlap.span_coverage(d, g).count() == 0


def test_splits(spark):
    target = spark.createDataFrame([("train", 0.5), ("test", 0.5), ("off", -1.0), (None, None)], TARGET).selectExpr("*", *[f"1 as `{c}`" for c in CLASH])
    out = {r.id: r.split for r in splits.split_records(dev(spark), target).collect()}
    assert set(out) == {r[0] for r in dev_rows() if r[0]} and set(out.values()) <= {"train", "test"}
    assert len({out[i] for i in ("AB-1", "half", "cd 9")}) == 1 and out["E-7"] == out["E-8"]
    assert splits.split_records(dev(spark, []), target).count() == 0


def test_vectors(spark):
    e = [[1.0 if i == j else 0.0 for i in range(64)] for j in range(3)]
    rows = [("AB-1", e[0], dt(2024, 1, 1)), ("AB-1", e[1], dt(2024, 1, 2)), ("AB-1", e[1], dt(2024, 1, 2)), ("AB-2", e[1], None), ("AB-3", [2e30 * v for v in e[1]], None), ("far", e[2], None), ("null", None, None), (None, e[1], None), ("holes", [None, *e[1][1:]], None), ("wide", e[1] + [0.0], None)]
    v = spark.createDataFrame(rows, VECTORS).selectExpr("*", *[f"1 as `{c}`" for c in CLASH])
    assert {tuple(r) for r in similar.most_similar(v).collect()} == {("AB-1", "AB-2"), ("AB-1", "AB-3"), ("AB-2", "AB-3")}
    pairs = {tuple(r) for r in clusters.cluster_pairs(dev(spark).where("length(heavy) < 1000 or heavy is null"), v).collect()}
    assert ("AB-1", "AB-3") in pairs and ("E-7", "E-8") in pairs and not any("none" in p or "Long-2" in p for p in pairs)
    assert clusters.cluster_pairs(dev(spark, []), v).count() == 0 and clusters.cluster_summary(dev(spark, []), v.limit(0)).count() == 0


def test_documents(spark):
    long = "Straße ｆｕｌｌ ​ é " * 20_000
    rows = [(1, "áb", "S"), (2, "áb", "s "), (3, "áb", "s"), (4, None, "s"), (5, "", "s"), (6, " ​", "s"), (7, long, None), (8, "ab", "s"), (9, long.replace("ｆｕｌｌ", "full"), "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", *[f"1 as `{c}`" for c in (*CLASH, "ids", "n_tokens", "canonical")])
    assert {tuple(r) for r in lookalike.lookalike_pairs(d).collect()} == {(1, 2), (1, 3), (7, 9)}
    forms = {r.doc_id: r.canonical for r in lookalike.canonical_text(d).collect()}
    assert forms[1] == forms[2] == "áb" and forms[4] is None and forms[5] == "" and forms[8] == "ab" and forms[7] == forms[9]
    alone = lookalike.canonical_text(d.where("doc_id = 1")).first()
    assert alone.canonical == forms[2]  # the form doesn't depend on the other rows
    ids = {r.doc_id: r.ids for r in encode.encode(d).collect()}
    assert ids[4] == ids[5] == [] and ids[2] == ids[3] and len(ids[7]) > 100_000
    target = spark.createDataFrame([("s", 1.0, 2), (None, 0.5, 1)], "source string, share double, max_repeats int")
    assert {r.doc_id for r in mixing.mixture(d, target)[0].collect()} == {1, 2, 6, 8, 9}
    for f in (lookalike.lookalike_pairs, lookalike.canonical_text, encode.encode):
        assert f(d.limit(0)).count() == 0
