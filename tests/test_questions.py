"""Readings that ask the same are one question, records alike are one to it, and stores of what was compared stay small."""

import random

import pytest

from rowloom.operators import names
from test_narrowing import likeness

FIELDS = "key long, names array<string>, families array<string>, givens array<string>, r_family string, r_given string, r_position string, r_hand string, r_age long, position string, hand string, short array<string>, family_length int, given_length int"


def test_alike_are_one(spark, monkeypatch):
    tables = {}
    kept = names.written
    monkeypatch.setattr(names, "written", lambda df, name: tables.setdefault(name, kept(df, name)))
    roster = [(u, f, g, p, "r", 20) for u, (f, g, p) in enumerate([(f, g, p) for _ in range(30) for f in ("anna", "hanna") for g in ("li", "lo") for p in ("p", "c")])]
    ask = lambda key, family, hand, age: (key, [family + "li"], [family], ["li"], family, "li", "p", hand, age, None, None, None, None, None)
    # an unknown hand isn't an empty one, an unknown age isn't one of 0
    reads = [ask(5 * i + j, *of) for i in range(40) for j, of in enumerate([("anna", "r", 20), ("anna", None, 20), ("anna", "", 20), ("anna", "", 0), ("anna", "", None)])]
    q = spark.createDataFrame(reads, FIELDS)
    r = spark.createDataFrame(roster, "uid long, family string, given string, position string, hand string, age int").repartition(5)
    got = names.best_named(q, r, "key", top=3).orderBy("key", "place").collect()
    assert tables["questions"].count() == 5 and tables["alike-records"].count() == 8 * 3
    assert [x["uid"] for x in got] == [0, 8, 16] * 200 and [x["place"] for x in got] == [1, 2, 3] * 200
    want = [0.88 + 0.055 + 0.04 + 0.008, 0.88 + 0.04 + 0.008, 0.88 + 0.04 + 0.008, 0.88 + 0.04, 0.88 + 0.04]
    assert [x["score"] for x in got[:15:3]] == pytest.approx(want)
    monkeypatch.undo()
    assert names.best_named(q.limit(0), r, "key").count() == 0 and names.best_named(q, r.limit(0), "key").count() == 0


@pytest.mark.parametrize("longest", [12, 64, 65])
def test_likeness(monkeypatch, longest):
    """Both ways to count edits, against a plain table; with room for all that was compared and for hardly any."""
    rnd = random.Random(longest)
    word = lambda n: "".join(rnd.choice("abc字") for _ in range(n))
    texts = ["", "a", word(longest), *[word(rnd.randint(1, longest)) for _ in range(30)]]
    reads = [word(rnd.randint(0, longest + 9)) for _ in range(12)] + texts[:4]
    for room in (names.KEPT, 50):
        monkeypatch.setattr(names, "KEPT", room)
        held = names._Texts(texts)
        for read in [*reads, *reads]:
            assert held.like(read).tolist() == pytest.approx([likeness(read, t) if t and read else 0.0 for t in held.texts]), read
        if room == 50:
            assert max(len(held.known), len(held.held), len(held.at)) <= 2
