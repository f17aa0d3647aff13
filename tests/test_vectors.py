"""Best rows by product against a plain loop: ties, copies, gates, own rows, vectors without a score, several blocks."""

import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.functions import numbers
from rowloom.operators import vectors


def test_rounded(spark):
    rnd = random.Random(3)
    values = [rnd.uniform(-2, 2) for _ in range(500)] + [k / 10**7 for k in range(-50, 50)] + [0.1234565, -0.1234565, 1e-9, -1e-9, 1e9 + 0.1234565, float("inf"), float("-inf")]
    want = [r["x"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(F.round("v", 6).alias("x")).collect()]
    assert vectors.rounded(np.array(values)).tolist() == want
    assert np.isnan(vectors.rounded(np.array([np.nan]))[0])


def plain(queries, rows, top, gated, own):
    """query, uid, place, score of every kept pair."""
    out = []
    for q, category, u in queries:
        found = []
        for uid, label, v in rows:
            if gated and category is not None and category != label:
                continue
            if own is not None and uid == q:
                score = own
            elif u is None or v is None or len(u) != len(v) or None in u or None in v:
                score = None
            else:
                score = 0.0
                for a, b in zip(u, v):
                    score += a * b
                score = float(Decimal(repr(score)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) + 0.0
            found.append((score is None, -(score or 0.0), uid, score))
        out += [(q, uid, place, score) for place, (_, _, uid, score) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("gated, own", [(False, None), (False, -2.0), (True, None), (True, -2.0)])
def test_best_by_product(spark, gated, own):
    rnd = random.Random(5)
    rows = [(i, rnd.randrange(3), [rnd.gauss(0, 0.4) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, i % 3, list(rows[7][2])) for i in range(60)]  # copies tie by id
    rows += [(400 + i, i % 3, [x + 1e-7 * i for x in rows[20][2]]) for i in range(40)]  # ties by rounding alone
    rows += [(500, 1, None), (501, 1, [1.0, None]), (502, 2, [0.5] * 3), (503, None, [0.1] * 8), (504, 0, [])]
    queries = [(i, None if i % 4 == 0 else l, v) for i, l, v in rows if i % 7 == 0 or i > 498]
    a = spark.createDataFrame(queries, "query_id long, category int, q array<double>")
    b = spark.createDataFrame(rows, "uid long, label int, u array<double>")
    for blocks in ({}, {"query_block": 20, "row_block": 50}):
        found = vectors.best_by_product(a, b, ("q", "u"), top=5, gate=("category", "label") if gated else None, own=own, more={"again": ("q", "u")}, **blocks)
        got = found.collect()
        assert sorted((r["query_id"], r["uid"], r["place"], r["score"]) for r in got) == plain(queries, rows, 5, gated, own)
        assert all(r["again"] == r["score"] for r in got if own is None or r["query_id"] != r["uid"])


def test_same_as_expression(spark):
    """Scores are those of Spark's own sum, to the last bit, and no pair is sorted or shuffled before it is scored."""
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("uid"), numbers.centred(F.col("embedding")).alias("u"))
    asked = rows.filter("uid % 20 = 0").select(F.col("uid").alias("query_id"), F.col("u").alias("q"))
    found = vectors.best_by_product(asked, rows, ("q", "u"), top=4)
    score = F.round(numbers.dot(F.col("q"), F.col("u")), 6)
    pairs = asked.crossJoin(rows).select("query_id", "uid", score.alias("want"))
    joined = found.join(pairs, ["query_id", "uid"])
    assert joined.count() == asked.count() * 4 and joined.filter("score <> want").count() == 0
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "Join" not in found._jdf.queryExecution().toString()


def test_non_finite(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [nan, 0.0]), (3, [inf, 1.0]), (4, [0.5, 0.0]), (5, [-inf, 0.0])]
    b = spark.createDataFrame(rows, "uid long, u array<double>")
    a = spark.createDataFrame([(9, [1.0, 1.0])], "query_id long, q array<double>")
    score = F.round(numbers.dot(F.col("q"), F.col("u")), 6)
    want = [r["uid"] for r in a.crossJoin(b).orderBy(score.desc(), "uid").collect()]
    got = [r["uid"] for r in vectors.best_by_product(a, b, ("q", "u"), top=5).orderBy("place").collect()]
    assert got == want == [2, 3, 1, 4, 5]
