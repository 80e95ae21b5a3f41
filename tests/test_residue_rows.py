from pyspark.sql import functions as F

import __spark_entry__ as entry
from chainloom.functions.sequence import annotate, annotate_rows, mutation_share

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_letters_are_compared_within_their_row(spark):
    assert "Generate" not in plan(entry.queries()["mutation_fraction"](spark, SF))
    d = spark.createDataFrame([("AAAA", "AACAT"), ("A", "C"), ("", "A"), (None, "A"), ("A" * 200, "C" + "A" * 150)], "h string, l string")
    assert [tuple(r) for r in d.select(*mutation_share("h", "l")).collect()] == [(4, 0.25), (1, 1.0), (None, None), (None, None), (104, 1 / 104)]


def test_residues_are_numbered_within_their_row(spark):
    assert "Join" not in plan(entry.queries()["residue_annotation"](spark, SF)).split("Generate explode(_rows")[0]
    rows = {"ok": [(0, "A", 1), (1, "C", 2)], "less": [(0, "A", 1)], "other": [(0, "A", 1), (1, "D", 2)], "open": [(1, "C", None), (0, "A", 1)], "twice": [(0, "A", 1), (0, "A", 1), (1, "C", 2)], "none": None}
    df = spark.createDataFrame([(k, "AC") for k in rows] + [("empty", "")], "id string, s string")
    kind = "id string, numbering array<struct<seq_index: int, aa: string, number: int, insertion: string>>"
    own = df.join(spark.createDataFrame([(k, v and [(*e, "") for e in v]) for k, v in rows.items()], kind), "id", "left")
    got = annotate_rows(own, ["id"], "s", "numbering").collect()
    assert {(r.id, r.status) for r in got} == {("ok", "OK"), ("less", "LENGTH_MISMATCH"), ("other", "SEQ_MISMATCH"), ("open", "PARTIAL_UNKNOWN"), ("twice", "LENGTH_MISMATCH"), ("none", "LENGTH_MISMATCH")}
    assert len(got) == 12 and {r.label for r in got if r.id == "open"} == {"1", None}
    long = own.select("id", F.explode("numbering").alias("e")).select("id", "e.*")
    assert sorted(map(str, annotate(df, ["id"], "s", long).collect())) == sorted(map(str, got))
