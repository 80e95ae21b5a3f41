import math

import pytest
from pyspark.sql import functions as F

from chainloom.functions import numbers as N
from chainloom.functions import sequence as D
from chainloom.functions import text as X


def one(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_identities(spark):
    pairs = [("ABC", "ABD"), ("AB", "ABCD"), ("", "A"), ("AB", "ACD"), (None, "A")]
    got = one(spark, "a string, b string", pairs, X.positional_identity("a", "b"), X.hamming_fraction("a", "b"), X.token_identity("a", "b"))
    assert got[0] == (pytest.approx(2 / 3), pytest.approx(1 / 3), pytest.approx(2 / 3))
    assert got[1] == (0.5, 0.5, 0.0) and got[2] == (0.0, None, 0.0)
    assert got[3][1] == pytest.approx(2 / 3) and got[4] == (None, None, None)


def test_clean_and_match(spark):
    assert one(spark, "s string", [("ac-d. *xZ",), (None,), ("",)], X.clean_sequence("s")) == [("ACD",), ("",), ("",)]
    cases = [("ABCD", "ABCD", "EXACT"), ("ABCD", "BC", "SUBSTRING"), ("ABCDE", "ABXDE", "NEAR"), ("ABCDEFGH", "Z", "MISMATCH"), (None, "A", "MISSING"), ("", "A", "MISSING")]
    assert [r[0] for r in one(spark, "a string, b string", [c[:2] for c in cases], X.match_status("a", "b"))] == [c[2] for c in cases]


def test_regex_and_json_cases(spark):
    assert one(spark, "s string", [("EXP-H001",), ("EXP-H001\n",), (None,)], X.full_match("s", "EXP-[THM][0-9]{3,}")) == [(True,), (False,), (False,)]
    assert one(spark, "s string", [("xgbOOST",), (None,)], X.contains_any("s", ["XGBoost"])) == [(True,), (False,)]
    assert one(spark, "s string", [('{"k": 3}',), ("broken",), (None,)], X.json_field("s", "$.k", "int")) == [(3,), (None,), (None,)]
    assert one(spark, "s string", [("a;b, c",), (None,), (";;",)], X.tokens("s")) == [(["a", "b", "c"],), ([],), ([],)]


def test_table_hash_ignores_order_and_partitions(spark):
    d = spark.range(300).select("id", (F.col("id") / 7).alias("v"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("t"))
    a = X.table_hash(d, "id", ["v", "t"]).first()
    assert a == X.table_hash(d.orderBy(F.desc("id")).repartition(5), "id", ["v", "t"]).first()
    assert a != X.table_hash(d.where("id > 0"), "id", ["v", "t"]).first()
    assert X.table_hash(d.limit(0), "id", ["v"]).first().n_rows == 0


def test_angles_and_vectors(spark):
    assert one(spark, "a double, b double", [(179.0, -179.0), (-179.0, 179.0), (10.0, 350.0)], N.angle_difference("a", "b")) == [(-2.0,), (2.0,), (20.0,)]
    got = one(spark, "u array<double>, v array<double>", [([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], N.cosine("u", "v"), N.angle_between("u", "v"))
    assert got[0] == (0.0, 90.0) and got[1] == (None, None) and got[2] == (None, None)


def test_padding_fails_on_bad_arrays(spark):
    assert one(spark, "v array<double>", [([1.0, 2.0],)], *N.padded("v", 3)) == [([1.0, 2.0, 0.0], [True, True, False])]
    for bad in ([1.0, math.nan], [0.0, 0.0], [1.0, 2.0, 3.0, 4.0]):
        with pytest.raises(Exception, match="array too long, not finite or all zero"):
            one(spark, "v array<double>", [(bad,)], *N.padded("v", 3))


def test_relative_surface_is_clipped_only_if_asked(spark):
    got = one(spark, "s double, a string", [(64.5, "A"), (258.0, "A"), (1.0, "X")], D.relative_surface("s", "a"), D.relative_surface("s", "a", clipped=True))
    assert got == [(0.5, 0.5), (2.0, 1.0), (None, None)]


def test_isoelectric_points_of_simple_peptides():
    import pandas as pd

    acid, base, none = D.isoelectric_points(pd.Series(["DDDD", "KKKK", None]))
    assert acid < 4 < 9 < base and math.isnan(none)


def test_fusion_and_regions(spark):
    assert one(spark, "v string", [("AAST",), ("AAA",), ("",), (None,)], *D.fuse("v", "STK")) == [("AASTK", 2), ("AAASTK", 0), (None, None), (None, None)]
    assert [r[0] for r in one(spark, "n int", [(1,), (27,), (105,), (128,), (129,), (None,)], D.region_of("n"))] == ["FR1", "CDR1", "CDR3", "FR4", "UNKNOWN", "UNKNOWN"]


def test_ngrams_of_short_texts(spark):
    assert one(spark, "t string", [("abc",), ("a",), ("",), (None,)], X.char_ngrams("t", 2)) == [(["ab", "bc"],), ([],), ([],), ([],)]
