"""Whitening: exact scatter, components against numpy, edge rows, large values."""

import math
import random

import numpy as np
import pytest

from rowloom.llm import whiten


@pytest.mark.parametrize("span", [1, 300, 2**40, 2**63 - 1])
def test_scatter(span):
    rng = np.random.default_rng(1)
    for rows in (1, 63, 64, 200):
        x = rng.integers(-span, span, (rows, 7), endpoint=True)
        x[:, 3] = 5
        total, cross = whiten.scatter(x)
        wide = x.astype(object)
        assert (total == wide.sum(axis=0)).all()
        assert (cross == wide.T @ wide).all()


def check(got, rows, top=4):
    kept = [(v, [math.floor(256 * c) for c in e]) for v, e in rows if e]
    distinct = np.array(sorted({tuple(x) for _, x in kept}), np.int64)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = distinct - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == len(kept) * min(top, len(sums))
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    for v, x in kept:
        off = n * np.array(x) - sums
        for c in range(min(top, len(sums))):
            r = by[v, c + 1][0]
            assert r["n"] == n and r["deviation"] == int((off * off).sum())
            want = off / n @ vectors[:, c] / math.sqrt(values[c])
            assert abs(abs(r["whitened"]) - abs(want)) < 1e-6
            assert abs(r["explained"] - values[c] / values.sum()) < 1e-9
            assert r["identity_error"] < 1e-9


def test_whiten(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1 + j) for j in range(6)]) for i in range(500)]
    rows += [(i, rows[7][1]) for i in range(500, 700)] + [(None, rows[3][1])]
    bad = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [math.nan] * 6), (904, [math.inf] * 6), (905, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, 1) for r in [*rows, *bad]], "vec_id long, embedding array<double>, component int")
    check(whiten.whiten(table).collect(), rows)
    assert whiten.whiten(table.limit(0)).count() == 0


def test_few_and_flat(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = whiten.whiten(table).collect()
    assert len(got) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 and r["n"] == 1 for r in got)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<float>")
    got = {(r["vec_id"], r["component"]): r for r in whiten.whiten(line).collect()}
    assert abs(got[0, 1]["explained"] - 1) < 1e-12 and got[0, 2]["whitened"] is None and got[0, 2]["explained"] == 0


def test_large_values(spark):
    rows = [(i, [1e12 * i, -1e30, 1.0]) for i in range(4)]
    got = whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r["deviation"] is None for r in got) and abs(got[0]["identity_error"]) < 1e-4
