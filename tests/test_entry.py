import __spark_entry__ as entry
from chainloom.operators.scores import segment_scores


def test_entry_gives_the_scores_by_segment(spark):
    assert sorted(r.segment for r in entry.entry(spark).collect()) == ["A", "N", "R"]


def test_segment_scores_by_hand(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 2.0), ("a", 3.0, 5.0), ("a", None, 1.0), ("a", float("nan"), 1.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0), (None, 1.0, 1.0)]
    got = {r.segment: tuple(r)[1:] for r in segment_scores(spark.createDataFrame(rows, "segment string, y double, p double")).collect()}
    assert got == {"a": (3, 1.0, 1.290994, 1.0, -1.5, 0.866025, 0.866025), "flat": (2, 0.5, 0.707107, 0.5, None, None, None)}
