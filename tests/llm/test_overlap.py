import random

from chainloom.llm import chains, overlap

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def spread(rng, text, d):
    """``text`` with ``d`` letters replaced at even distances around the ring."""
    out, n = list(text), len(text)
    for j in range(d):
        at = j * n // d
        out[at] = rng.choice([c for c in LETTERS if c != out[at]])
    return "".join(out)


def pairs_with_spread_edits(seed=5):
    rng = random.Random(seed)
    cases = []
    for n in (38, 70, 149, 151, 169, 171, 200, 217, 230, 234, 239, 450):
        for part in range(3):
            text = "".join(rng.choice(LETTERS) for _ in range(n))
            most = int(0.06 * n + 1e-9)
            other = spread(rng, text, most)
            cut = n // 2
            cases.append(((text[:cut], text[cut:]), (other[cut:], other[:cut]) if part == 1 else (other[:cut], other[cut:])))
    return cases


def test_p4_found_keeps_pairs_whose_edits_lie_evenly(spark):
    rows, folds = [], []
    for j, pair in enumerate(pairs_with_spread_edits()):
        for side, (heavy, light) in zip("ab", pair):
            rows.append((f"{j:03}{side}", heavy, light))
            folds.append(("primary", f"{j:03}{side}", "ab".index(side), None))
    dev = spark.createDataFrame(rows, "id string, heavy string, light string")
    split = spark.createDataFrame(folds, "scheme string, id string, fold int, assigned_at timestamp")
    got = {(r.id_a, r.id_b) for r in overlap.cross_split(dev, split).collect()}
    assert got == {(f"{j:03}a", f"{j:03}b") for j in range(len(rows) // 2)}


def test_parities_leave_every_pair_within_the_threshold(spark):
    rng = random.Random(9)
    rows, want = [], set()
    for j in range(300):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.choice((20, 60, 231, 400))))
        other = list(text)
        for _ in range(int(0.06 * len(text))):
            at = rng.randrange(len(other))
            kind = rng.random()
            other[at : at + (kind > 0.3)] = [] if kind > 0.8 else [rng.choice(LETTERS)]
        rows += [(2 * j, "", text), (2 * j + 1, "", "".join(other))]
        want.add((2 * j, 2 * j + 1))
    classes = spark.createDataFrame(rows, "k long, x string, y string")
    candidates = spark.createDataFrame(sorted(want), "ka long, kb long")
    text = {r[0]: r[2] for r in rows}
    exact = {(a, b) for a, b in want if chains.best_edits("", text[a], "", text[b], 0.94)}
    assert {(r.ka, r.kb) for r in chains.verified(candidates, classes, 0.94).collect()} == exact and len(exact) > 200


def table_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_bit_parallel_edits_equal_the_table():
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choice("ABC") for _ in range(rng.randrange(0, 14)))
        b = "".join(rng.choice("ABC") for _ in range(rng.randrange(0, 14)))
        d = table_edits(a, b)
        for most in (0, 2, 5, 20):
            assert chains.edits(a, b, most) == min(d, most + 1)
    long = "".join(rng.choice(LETTERS) for _ in range(3000))
    assert chains.edits(long, long[:700] + "W" + long[705:], 9) == table_edits(long[690:720], long[690:700] + "W" + long[705:720])


def test_exchanged_chains_take_the_least_edits():
    assert chains.best_edits("AAAACCCC" * 5, "GGGGTTTT" * 5, "GGGGTTTT" * 5, "AAAACCCC" * 5, 0.94) == (0, 80)


def test_coverage_merges_spans_of_other_folds(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    span, a, b = text(40), text(50), text(50)
    dev = spark.createDataFrame([("x", a + span, ""), ("y", span + b, None), ("same", a, "short"), ("alone", text(60), text(30)), ("tiny", "ACD", None), ("nofold", span, None)], "id string, heavy string, light string").selectExpr("*", "'s' as source")
    folds = spark.createDataFrame([("p", "x", 0, None), ("p", "y", 1, None), ("p", "same", 0, None), ("p", "alone", 2, None), ("p", "tiny", 3, None), ("p", "nofold", None, None)], "scheme string, id string, fold int, assigned_at timestamp")
    got = {r.id: (r.fold, r.letters, r.covered) for r in overlap.span_coverage(dev, folds).collect()}
    assert got == {"x": (0, 90, 40), "y": (1, 90, 40), "same": (0, 50, 0), "alone": (2, 90, 0)}
    report = overlap.coverage_report(overlap.span_coverage(dev, folds), dev).where("fold = 0").first()
    assert (report.n_records, report.n_touched, report.n_half) == (2, 1, 0)


def test_every_pair_at_the_threshold_shares_a_kept_suffix():
    import numpy as np

    from chainloom.llm.overlap import LONGEST, suffixes

    rng = np.random.default_rng(8)
    for n in (17, 34, 50, 84, 134, 171, 234):
        edits, pairs = int(0.06 * n + 1e-9), 2000
        a = rng.integers(65, 85, (pairs, n)).astype(np.uint8)
        b = a.copy()
        for i in range(edits):  # evenly, the worst case
            at = n * i // edits
            b[:, at] = 65 + (b[:, at] - 65 + 1 + rng.integers(0, 19, pairs)) % 20
        b = np.roll(b, n // 3, axis=1)  # the chains exchanged
        rings = np.concatenate([a, b])
        rings = np.concatenate([rings, rings[:, : LONGEST - 1]], axis=1)
        row, head = suffixes(rings.ravel(), np.arange(len(rings) + 1) * rings.shape[1])
        kept = {(r, h) for r, h in zip(row.tolist(), head.tolist())}
        found = {r for r, h in kept if (r + pairs, h) in kept}
        assert len(found) == pairs, n
