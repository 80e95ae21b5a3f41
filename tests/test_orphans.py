from datetime import datetime as dt

from chainloom.operators.orphans import missing_parents, normal_path, orphan_counts, orphan_references

CODES = "experiment_code string, registered_at timestamp, config_path string, oof_primary_path string, test_prediction_path string, feature_path string"
FILES = "path string, created_at timestamp, deleted_at timestamp"


def t(day):
    return dt(2024, 1, day)


def test_paths_in_one_spelling(spark):
    cases = {" a//b/./c ": "a/b/c", "a\\b": "a/b", "a/x/../b": "a/b", "../a": "../a", "a/../../b": "../b", "": "", " \t": "", "A/b": "A/b", "./": ""}
    d = spark.createDataFrame([(k,) for k in cases] + [(None,)], "p string")
    assert {r.p: r.n for r in d.select("p", normal_path("p").alias("n")).collect()} == {**cases, None: None}


def test_lives_and_newest_rows(spark):
    rows = [
        ("E1", t(5), "a", "gone", "late", " "), ("E1", t(1), "old", None, None, None), ("E1", t(5), "a", "gone", "late", " "),
        ("E2", t(10), "./twice", "twice", None, "never"), ("E3", None, "a", None, None, None), (None, t(3), "a", None, None, ""),
    ]
    files = [("a", t(1), None), ("a", t(1), None), ("gone", t(1), t(5)), ("late", t(6), None), ("twice", t(1), t(2)), ("twice", t(8), t(11)), ("broken", t(4), t(2)), (None, t(1), None)]
    e = spark.createDataFrame(rows, CODES).selectExpr("*", "'clash' as path", "1 as at")
    a = spark.createDataFrame(files, FILES).selectExpr("*", "0 as key")
    out = orphan_references(e, a)
    assert {(r.experiment_code, r.ref_field, r.path) for r in out.collect()} == {("E1", "oof_primary_path", "gone"), ("E1", "test_prediction_path", "late"), ("E2", "feature_path", "never"), ("E3", "config_path", "a")}
    counts = {(r.ref_field, r.month): r.n_orphans for r in orphan_counts(out).collect()}
    assert counts == {("oof_primary_path", "2024-01"): 1, ("test_prediction_path", "2024-01"): 1, ("feature_path", "2024-01"): 1, ("config_path", None): 1}


def test_hot_keys_split_without_changing_rows(spark):
    kids = spark.createDataFrame([("hot", t(1 + i % 20), i) for i in range(500)] + [("cold", t(3), 999), (None, t(3), 0)], "key string, at timestamp, n long")
    parents = spark.createDataFrame([("hot", t(4), t(9))], "key string, created_at timestamp, deleted_at timestamp")
    whole = sorted(tuple(r) for r in missing_parents(kids, parents).collect())
    assert whole == sorted(tuple(r) for r in missing_parents(kids, parents, salt_rows=20).collect())
    assert len(whole) == 1 + sum(not 4 <= 1 + i % 20 < 9 for i in range(500))


def test_empty_tables(spark):
    e, a = spark.createDataFrame([], CODES), spark.createDataFrame([], FILES)
    assert orphan_references(e, a).count() == 0
    assert orphan_references(spark.createDataFrame([("E", t(1), "x", None, None, None)], CODES), a).count() == 1
