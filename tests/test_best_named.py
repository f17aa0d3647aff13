"""The best records for names as read, against a plain loop: gates, lists of readings, ties, several blocks."""

import random

import pytest

from rowloom.operators import names
from test_narrowing import likeness


def test_best_named(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 6)))
    some = [word() for _ in range(12)]
    roster = [(i, rnd.choice(some), rnd.choice(some[:4]), rnd.choice("pc"), rnd.choice("rl"), rnd.choice([20, 21, None])) for i in range(400)]
    reads = []
    for i in range(60):
        families, givens = [rnd.choice([*some, word()]) for _ in range(i % 3)], [word() for _ in range(i % 2)]
        reads.append((i, [a + b for a in families for b in givens] + families, families, givens, rnd.choice(["", *some]), rnd.choice(["", *some]), rnd.choice(["", "p"]), rnd.choice(["", "l"]), rnd.choice([None, 20]), rnd.choice([None, "p"]), rnd.choice([None, "l"]), rnd.choice([None, some[:5]]), rnd.choice([None, 3]), rnd.choice([None, 2])))
    text = "array<string>"
    q = spark.createDataFrame(reads, f"key long, names {text}, families {text}, givens {text}, r_family string, r_given string, r_position string, r_hand string, r_age long, position string, hand string, short {text}, family_length int, given_length int")
    r = spark.createDataFrame(roster, "uid long, family string, given string, position string, hand string, age int")
    want = {}
    for key, whole, families, givens, rf, rg, rp, rh, ra, gp, gh, short, fl, gl in reads:
        found = []
        for uid, f, g, p, h, a in roster:
            if (gp and p != gp) or (gh and h != gh) or (short is not None and f not in short) or (fl is not None and abs(len(f) - fl) > 1) or (gl is not None and abs(len(g) - gl) > 1):
                continue
            most = lambda rs, t: max([likeness(x, t) for x in rs], default=0.0)
            weight = (0.54 if families else 0.0) + (0.46 if givens else 0.0)
            like = max(most(whole, f + g), (most(families, f) * 0.54 + most(givens, g) * 0.46) / (weight or 1.0))
            score = like * 0.88 + 0.055 * (rh == h) + 0.04 * (rp == p) + 0.008 * (ra is not None and ra == a) - 0.06 * (rf != "" and abs(len(f) - len(rf)) > 1) - 0.06 * (rg != "" and abs(len(g) - len(rg)) > 1)
            found.append((-round(score, 8), uid))
        want[key] = sorted(found)[:5]
    for blocks in ({}, {"read_block": 20, "row_block": 90}):
        got = {}
        for x in names.best_named(q, r, "key", top=5, **blocks).orderBy("key", "place").collect():
            got.setdefault(x["key"], []).append((-x["score"], x["uid"]))
        for key, pairs in want.items():
            assert [u for _, u in got.get(key, [])] == [u for _, u in pairs], key
            assert [s for s, _ in got.get(key, [])] == pytest.approx([s for s, _ in pairs])
