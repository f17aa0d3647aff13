"""Periodic runs against a plain search, planted documents, edge rows."""

import hashlib
import random
import zlib
from fractions import Fraction

from rowloom.llm import periods
from rowloom.llm.queries import op12_runs


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i + q] for i in range(len(words) - q)))


def slow_runs(words, least=24, times=3):
    out, n = set(), len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, times * q) and smallest_period(words[i : i + size]) == q:
                out.add((i, size, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_collapse(words, runs):
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def make(rnd):
    words = []
    while len(words) < 150:
        kind = rnd.random()
        block = [rnd.choice("ab" if kind < 0.5 else "abcdefgh") for _ in range(rnd.randint(1, 12))]
        words += (block * rnd.randint(1, 9))[: rnd.randint(1, 70)]
    return words[: rnd.randint(0, 150)]


def test_against_search(spark):
    rnd = random.Random(3)
    texts = [make(rnd) for _ in range(250)] + [["a"] * 24, ["a"] * 23, ["a", "b"] * 12, [], ["x"], (["a"] * 30 + ["b"]) * 4]
    docs = spark.createDataFrame([(i, "\t".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for least, times, block in ((24, 3, 500_000), (6, 3, 90), (24, 4, 1)):
        for r in periods.find_runs(docs, least=least, times=times, block=block).collect():
            words = texts[r["doc_id"]]
            want = slow_runs(words, least, times)
            assert [tuple(x) for x in r["runs"]] == want, words
            assert r["n_words"] == len(words)
            assert r["collapsed"] == slow_collapse(words, want)


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    words = [w.decode() for w in words]
    runs = slow_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = best[1] * 1000 // best[2] if runs else None
    return (len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(slow_collapse(words, runs)))


def test_query(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, " ".join(make(rnd))) for i in range(200)] + [(None, "a " * 30), (7, None), (8, ""), (9, "   x\x1cy" * 30), (9, "   x\x1cy" * 30), (250, "one")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, runs int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted([(r["doc_id"], tuple(r[c] for c in names)) for r in op12_runs(spark, str(tmp_path)).collect()], key=str)
    assert got == sorted([(d, expected(d, t)) for d, t in rows], key=str)
    assert periods.find_runs(docs.limit(0)).count() == 0


def test_long_texts(spark):
    long = " ".join(f"w{i % 70_001}" for i in range(300_000))
    docs = spark.createDataFrame([(1, long), (2, "a " * 400_000)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periods.find_runs(docs).collect()}
    assert got == {1: [(0, 300_000, 70_001)], 2: [(0, 400_000, 1)]}
