"""Nearest neighbours: recall against brute force, exact scores, copies, vectors that take no part."""

import numpy as np
from pyspark.sql import functions as F

from rowloom.llm import ann


def run(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 24))
    vectors = (centres[rng.integers(0, 8, 3000)] + rng.normal(size=(3000, 24)) * rng.uniform(0.3, 1.5, (3000, 1))).astype(np.float32)
    vectors[1000:1400] = vectors[7]
    ids = list(range(3000))
    got = run(spark, [(i, v.tolist(), 0) for i, v in zip(ids, vectors, strict=True)])
    assert len(got) == 150
    hits = 0
    for q, found in got.items():
        true = ann.brute_force(ids, vectors.astype(np.float64), q)
        assert len(found) == 20 and q not in dict(found)
        hits += len(set(dict(true)) & set(dict(found)))
        for i, score in found:
            assert abs(score - float(vectors[i].astype(np.float64) @ vectors[q].astype(np.float64))) < 1e-9
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    assert hits / 3000 >= 0.9


def test_few_and_odd(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, None, 0), (3, [0.0, 0.0], 0), (4, [float("nan"), 1.0], 0), (5, [float("inf"), 1.0], 0), (20, [0.0, 0.0], 0), (6, [2.0, 0.0], 0), (7, [2.0, 0.0], 0), (8, [None, 1.0], 0), (9, [], 0)]
    assert run(spark, rows) == {0: [(6, 2.0), (7, 2.0), (1, 0.5)]}
    assert run(spark, rows[1:4]) == {}
    assert run(spark, []) == {}
    # shards, and results dealt to several tasks, change nothing here
    assert run(spark, rows, least_shards=1) == run(spark, rows, heavy=1) == run(spark, rows)


def exact(rows, k=20):
    """Every query row's true nearest, its own row left out; keyed by id and vector."""
    out = {}
    for at, (q, v) in enumerate(rows):
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for j, (i, w) in enumerate(rows) if j != at and len(w) == len(v))
            out[q, tuple(v)] = [(i, -s) for s, i in best[:k]]
    return out


def test_ties_repeats_lengths(spark):
    """39 different vectors at one score, copies of rows, one id on two vectors, vectors of other lengths."""
    rows = [(0, [1.0, 0.0])] + [(100 - i, [0.5, float(i)]) for i in range(1, 40)]
    rows += [(20, [3.0, 1.0]), (20, [1.0, 3.0]), (40, [0.25, 0.0]), (40, [0.25, 0.0]), (7, [1.0, 0.0])]
    rows += [(200, [1.0, 0.0, 0.0]), (201, [2.0, 0.0, 1.0]), (202, [1.0])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    for options in ({}, {"least_shards": 1, "heavy": 1}):
        vectors = {}
        for r in ann.nearest(table, F.col("vec_id") % 20 == 0, **options).collect():
            vectors.setdefault((r["query_id"], r["query_key"]), {})[r["rank"]] = (r["vec_id"], r["score"])
        got = sorted((q, [ranked[n] for n in range(1, len(ranked) + 1)]) for (q, _), ranked in vectors.items())
        assert got == sorted((q, found) for (q, _), found in exact(rows).items())
