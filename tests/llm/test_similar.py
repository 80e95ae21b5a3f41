import numpy as np

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


def brute_force(spark):
    best = {}
    for r in spark.read.parquet(f"{SF}/stage2_embeddings.parquet").collect():
        if r.ids is not None and (r.ids not in best or r.extracted_at > best[r.ids].extracted_at):
            best[r.ids] = r
    usable = {i: np.array(r[1], float) for i, r in sorted(best.items()) if r[1] is not None and len(r[1]) == 64 and None not in r[1]}
    usable = {i: v / np.linalg.norm(v) for i, v in usable.items() if np.isfinite(v).all() and v.any()}
    ids, x = list(usable), np.array(list(usable.values()))
    c = x @ x.T
    np.fill_diagonal(c, -1)
    out = set()
    for i, row in enumerate(c):
        for j in np.lexsort((np.arange(len(ids)), -row))[:10]:
            if row[j] >= 0.90:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def test_p1_found_against_brute_force(spark):
    want = brute_force(spark)
    got = [tuple(r) for r in entry.queries()["p1_found"](spark, SF).select("id_a", "id_b").collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    assert len(want) > 1000
    assert len(want & set(got)) >= 0.98 * len(want)
    assert len(want & set(got)) >= 0.98 * len(got)


def test_p1_found_leaves_out_unusable_vectors_and_takes_an_empty_table(spark, tmp_path):
    from chainloom.llm.similar import most_similar

    kind = "ids string, ablang2__HL_paired array<float>, extracted_at timestamp"
    good, other = [1.0] + [0.0] * 63, [0.0] * 63 + [2.0]
    rows = [("a", good, None), ("b", [5.0] + [0.0] * 63, None), ("c", other, None), ("d", [0.0] * 64, None), ("e", [float("nan")] + good[1:], None), ("f", good[:9], None), ("g", None, None)]
    df = spark.createDataFrame(rows, kind)
    assert [tuple(r) for r in most_similar(df).collect()] == [("a", "b")]
    assert most_similar(df.limit(0)).count() == 0


def test_copies_of_a_vector_are_indexed_once(spark):
    from chainloom.llm.similar import most_similar

    rng = np.random.default_rng(6)
    base = rng.normal(size=(6, 64))
    rows = [(f"m{i:02}", base[0].tolist(), None) for i in range(40)] + [(f"n{i}", (base[0] + rng.normal(size=64) * 0.05).tolist(), None) for i in range(12)]
    rows += [(f"p{i}", base[1].tolist(), None) for i in range(3)] + [(f"q{i}", (base[1] + rng.normal(size=64) * 0.05).tolist(), None) for i in range(4)] + [("far", base[2].tolist(), None)]
    got = {tuple(r) for r in most_similar(spark.createDataFrame(rows, "ids string, ablang2__HL_paired array<float>, extracted_at timestamp")).collect()}
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(x @ x.T, 6)
    want = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i and c[i, j] >= 0.90), key=lambda j: (-c[i, j], ids[j]))
        want |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order[:10]}
    assert len(want ^ got) <= 2
