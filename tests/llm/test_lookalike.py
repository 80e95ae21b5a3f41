from chainloom.llm.lookalike import canonical_text, lookalike_pairs

SAME = [("ёx", "ёx", "ëx", "ëx"), ("їy", "їy", "ïy"), ("όz", "όz", "óz"), ("Άw", "Άw", "Áw"), ("ἀq", "ἀq", "a̓q"), ("αρυ", "apu"), ("ᎪᏟ", "AC"), ("Ⲥⲟ", "Co")]


def test_joined_and_separate_accents_over_lookalikes_meet(spark):
    rows, want = [], set()
    for group in SAME:
        ids = range(len(rows), len(rows) + len(group))
        rows += list(zip(ids, group))
        want |= {(a, b) for a in ids for b in ids if a < b}
    rows += [(900, "ex"), (901, "йx"), (902, "иx"), (903, "oz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in lookalike_pairs(df).collect()} == want
    forms = dict(map(tuple, canonical_text(df).collect()))
    assert all((forms[a] == forms[b]) == ((min(a, b), max(a, b)) in want) for a in forms for b in forms if a != b)
