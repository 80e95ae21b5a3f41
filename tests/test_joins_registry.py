import pytest

from chainloom.operators import joins as J
from chainloom.operators import registry as V
from chainloom.operators import select as P
from chainloom.operators import sets as U


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_alignment_contract(spark):
    ids = frame(spark, [("a", 0), ("b", 1)], "id string, pos int")
    ok = frame(spark, [("b", 2.0), ("a", 1.0), ("x", 9.0)], "id string, v double")
    assert [tuple(r) for r in J.align(ok, ids).orderBy("pos").collect()] == [("a", 0, 1.0), ("b", 1, 2.0)]
    for rows, message in [
        ([("a", 1.0), ("a", 1.0), ("b", 1.0)], "repeated ids"), ([("a", 1.0)], "missing ids"), ([("a", None), ("b", float("nan"))], "no finite value"), ([], "empty block"),
    ]:
        with pytest.raises(J.ContractError, match=message):
            J.align(frame(spark, rows, "id string, v double"), ids)
    with pytest.raises(J.ContractError, match="no numeric column"):
        J.align(frame(spark, [("a", "x"), ("b", "y")], "id string, v string"), ids)
    assert J.align(frame(spark, [("a", 1.0)], "id string, v double"), ids, strict=False).count() == 1


def test_one_to_one_join_fails_on_repeats(spark):
    a = frame(spark, [(1, "x"), (2, "y")], "k int, a string")
    assert J.join_one_to_one(a, frame(spark, [(1, 5), (3, 6)], "k int, b int"), ["k"]).collect()[0].b == 5
    with pytest.raises(Exception, match="right side repeats key 1"):
        J.join_one_to_one(a, frame(spark, [(1, 5), (1, 6)], "k int, b int"), ["k"]).collect()


def test_block_concat_modes(spark):
    a, b = frame(spark, [("x", 1)], "id string, v int"), frame(spark, [("x", 2)], "id string, v int")
    assert J.concat_blocks({"a": a, "b": b}).columns == ["id", "a__v", "b__v"]
    with pytest.raises(J.ContractError):
        J.concat_blocks({"a": a, "b": b}, on_clash="fail")
    assert J.concat_blocks({"a": a, "b": b}, on_clash="first").collect()[0].v == 1


def test_slots_align_and_truncate(spark):
    d = frame(spark, [("ABCDEF",), ("AB",), ("",), (None,)], "t string")
    got = [[(s.slot, s.letter) for s in r.s] if r.s is not None else None for r in d.select(J.slots("t", 10, 13).alias("s")).collect()]
    assert got == [[(10, "A"), (11, "B"), (12, "E"), (13, "F")], [(10, "A"), (11, "B")], [], None]
    assert [(s.slot, s.letter) for s in d.select(J.slots("t", 10, 13, align_right=True).alias("s")).collect()[1].s] == [(12, "A"), (13, "B")]


def test_resolution_statuses(spark):
    q = frame(spark, [(1, "p"), (2, "q"), (3, "r"), (4, None)], "k int, name string")
    index = frame(spark, [("p", "T1", "s"), ("q", "T2", "s"), ("q", "T3", "s"), ("r", "T4", "s"), ("r", "T5", "t")], "token string, target string, value string")
    got = {r.k: (r.target, r.status) for r in J.resolve(q, "k", [("name", "name", index)], "value").collect()}
    assert got == {1: ("T1", "unique"), 2: ("T2", "same_value"), 3: (None, "ambiguous"), 4: (None, "unresolved")}


def test_bands_and_flags(spark):
    d = frame(spark, [(10.49,), (10.5,), (11.5,), (11.51,), (None,)], "v double")
    assert [r.b for r in d.select(P.band("v", 10.5, 11.5).alias("b")).collect()] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", None]
    t = frame(spark, [(" TRUE",), ("1",), ("yes",), (None,)], "t string")
    assert [r.f for r in t.select(P.parse_flag("t").alias("f")).collect()] == [True, True, False, False]
    assert [r.n for r in frame(spark, [("1.5 ",), ("x",), ("nan",), (None,)], "t string").select(P.parse_number("t").alias("n")).collect()] == [1.5, None, None, None]


def test_set_relations_of_empty_sets(spark):
    e = frame(spark, [], "id string")
    r = U.relation(e, e).first()
    assert (r.n_common, r.jaccard, r.equal, r.disjoint) == (0, None, True, True)
    assert len(U.subsets(["a", "b", "c"])) == 7


def test_submission_messages(spark):
    sol = frame(spark, [("a",), ("b",)], "id string")
    good = V.validate_submission(frame(spark, [("a", "1"), ("b", "2.5")], "id string, v string"), sol, "id", ["v"]).first()
    assert good.ok and good.messages == []
    bad = V.validate_submission(frame(spark, [("a", "x"), ("a", "inf"), ("z", "1")], "id string, v string"), sol, "id", ["v"]).first()
    assert bad.messages == ["infinite v: 1", "missing ids: 1", "missing v: 1", "repeated ids: 1", "rows: 3 for 2", "unknown ids: 1"]
    assert V.validate_submission(sol, sol, "id", ["v"]).first().messages == ["missing column: v"]


def test_label_guard_opens_once_enabled(spark):
    guard = V.LabelGuard(lambda: spark.range(1))
    with pytest.raises(PermissionError):
        guard.read()
    guard.enable()
    assert guard.read().count() == 1


def test_issue_appends_codes(spark):
    reg = frame(spark, [("EXP-H007",), ("EXP-H002",), ("odd",)], "code string")
    new = frame(spark, [("n2", "H"), ("n1", "H"), ("n3", "T")], "id string, namespace string")
    assert {r.id: r.code for r in V.issue(reg, new).collect()} == {"n1": "EXP-H008", "n2": "EXP-H009", "n3": "EXP-T001"}


def test_normalised_predictions_fail_on_missing(spark):
    ids = frame(spark, [("a",), ("b",)], "id string")
    with pytest.raises(Exception, match="no single prediction for b"):
        V.normalise_predictions(frame(spark, [("a", 1.0)], "id string, p double"), ids, "id").collect()


def test_upsert_and_pending(spark):
    m = frame(spark, [(1, "old"), (2, "old")], "k int, v string")
    out = V.upsert(m, frame(spark, [(2, "new", 5)], "k int, v string, extra int"), ["k"])
    assert {(r.k, r.v, r.extra) for r in out.collect()} == {(1, "old", None), (2, "new", 5)}
    work = frame(spark, [(1, "c1"), (2, "c1")], "k int, config string")
    assert [r.k for r in V.pending(work, frame(spark, [(1, "c1"), (2, "c0")], "k int, config string"), ["k"], "config").collect()] == [2]
