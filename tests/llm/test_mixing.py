from chainloom.llm.mixing import mixture, reached_shares

TARGET = "source string, share double, max_repeats int"


def test_shares_repeats_and_cases(spark):
    docs = [(i, f"text number {i} of the big source with some words", " Big ") for i in range(200)] + [(1000 + i, f"small text {i} with words in it", "small") for i in range(20)]
    docs += [(2000, "", "small"), (2001, None, "small"), (2002, "unlisted text", "other"), (2003, "no source", None), (2004, "text number 0 of the big source with some words", "small")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    target = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("absent", 0.0, 2)], TARGET)
    chosen, plan = mixture(df, target)
    rows = chosen.collect()
    uses = {}
    for r in rows:
        uses.setdefault((r.source, r.doc_id), []).append(r.use_no)
    assert all(sorted(u) == list(range(1, len(u) + 1)) and len(u) <= (3 if s == "small" else 1) for (s, _), u in uses.items())
    assert not {2000, 2001, 2002, 2003, 2004} & {d for _, d in uses}
    assert all(0 <= r.position <= 1 for r in rows) and [r.position for r in rows] == sorted(r.position for r in rows)
    reached = {r.source: r.reached for r in reached_shares(chosen, target).collect()}
    assert abs(reached["big"] - 0.6) < 0.02 and abs(reached["small"] - 0.4) < 0.02 and reached["absent"] == 0.0


def test_empty_tables(spark):
    target = spark.createDataFrame([("big", 1.0, 1)], TARGET)
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixture(none, target)[0].count() == 0
    assert mixture(none, target.limit(0))[0].count() == 0
