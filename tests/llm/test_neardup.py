import random

from chainloom.llm import neardup

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def edited(rng, text, d):
    out = list(text)
    for at in rng.sample(range(len(text)), d):
        out[at] = rng.choice([c for c in LETTERS if c != out[at]])
    return "".join(out)


def test_p5_found_keeps_far_pairs_beside_a_hot_group(spark):
    rng = random.Random(3)
    draw = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    rows, far = [], set()
    hot = draw(230)
    rows += [(f"h{j:03}", edited(rng, hot, 1), "") for j in range(200)]
    for n, d in ((230, 13), (450, 27)):
        for j in range(600):
            text = draw(n)
            rows += [(f"{n}_{j:03}a", text, ""), (f"{n}_{j:03}b", edited(rng, text, d), "")]
            far.add((f"{n}_{j:03}a", f"{n}_{j:03}b"))
    got = {(r.id_a, r.id_b) for r in neardup.near_pairs(spark.createDataFrame(rows, "id string, heavy string, light string")).collect()}
    assert len(far & got) >= 0.99 * len(far)
    assert {p for p in got if p[0][0] != "h"} <= far
    assert sum(p[0][0] == "h" for p in got) >= 0.999 * 200 * 199 / 2
