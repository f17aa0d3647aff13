"""Components against plain union-find: stars, paths, tight groups, repeated and empty links, many small shares."""

import random

import pytest

from rowloom.llm import simhash
from rowloom.llm.components import components


def slow(links):
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in list(root)}


@pytest.mark.parametrize("at_once", [20, 1_000_000])
def test_shapes(spark, at_once):
    rnd = random.Random(2)
    star = [(0, i) for i in range(1, 60)]
    path = [(i, i + 1) for i in range(1000, 1050)]
    crossing = [(-i, -rnd.randint(1, 90)) for i in range(1, 90)]
    links = star + path + crossing + [(5, 5), (0, 1), (1, 0), (-(1 << 63), (1 << 63) - 1)]
    want = {n: r for n, r in slow(links).items()}
    found = components(spark.createDataFrame(links, "a long, b long"), at_once=at_once).collect()
    got = {r["node"]: r["label"] for r in found}
    assert len(got) == len(found) and got == {n: want[n] for n in got}
    assert set(want) - set(got) <= {n for n in want if want[n] == n}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tight_group(spark):
    """A group of 2,000 fingerprints that lie within 4 bits of one another: one component, links in proportion to its size."""
    rnd = random.Random(9)
    hub, made = rnd.getrandbits(63), set()
    while len(made) < 2000:
        at = hub
        for b in rnd.sample(range(63), 2):
            at ^= 1 << b
        made.add(at)
        if len(made) % 3 == 0:
            made.add(hub ^ (1 << rnd.randrange(63)))
    fps = spark.createDataFrame([(f,) for f in made], "fp long")
    links = simhash.links(fps).cache()
    assert links.count() <= 66 * len(made)
    labels = {r["label"] for r in components(links).collect()}
    assert labels == {min(made)}
    links.unpersist()
