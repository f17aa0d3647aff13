"""Quality: the fit against its likelihood, held-out accuracy, edge rows."""

import numpy as np

from rowloom.llm import quality as Q


def test_fit_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    grade = np.digitize(x @ [2.0, -1.0, 0.0] + rng.logistic(size=4000), [-1.0, 0.5, 2.0])
    w, t = Q.fit_ordinal(x, grade, 4, np.full(3, 1e-3))
    assert np.allclose(w, [2, -1, 0], atol=0.2) and np.allclose(t, [-1, 0.5, 2], atol=0.2)


def test_features_are_rowwise():
    texts = ["word word other\nline", None, "", "é" * 10, "abc", "x" * 100_000]
    model = Q.OrdinalModel(np.arange(Q.SIZE, dtype=np.float32), np.ones(9), np.zeros(9), np.ones(9), np.array([0.0, 1.0]))
    together = model.margin(texts)
    assert np.allclose(together, [model.margin([t])[0] for t in texts])
    assert together[1] == together[2]


def slow_margin(text, model):
    """Features and margin of one text, byte by byte."""
    raw = (text or "").encode()
    data = raw if len(raw) > 4 else raw.ljust(5, b"\0")

    def kind(byte):
        if byte in (9, 11, 12, 13, 32):
            return 0
        if byte == 10:
            return 1
        c = chr(byte)
        return 5 if byte >= 128 else 2 if c.isalpha() else 3 if c.isdigit() else 4

    n, kinds = len(data), [kind(b) for b in data]
    code = [int.from_bytes(data[i : i + 4], "little") * 2654435761 % 2**32 // (2**32 // Q.SIZE) for i in range(n - 3)]
    heads = [code[i] for i in range(n - 3) if kinds[i] >= 2 and (i == 0 or kinds[i - 1] < 2)]
    shape = [np.log1p(len(raw)) / 10, *[kinds.count(k) / n for k in range(6)], sum(a == b for a, b in zip(data, data[1:], strict=False)) / n]
    shape.append(1 - len(set(heads)) / len(heads) if heads else 0)
    z = np.clip((np.array(shape) - model.mean) / model.spread, -6, 6)
    return np.mean([model.gram[c] for c in code]) + z @ model.shape


def test_brute_force():
    rng = np.random.default_rng(3)
    model = Q.OrdinalModel(rng.normal(size=Q.SIZE).astype(np.float32), rng.normal(size=9), rng.normal(size=9), np.ones(9), np.array([0.0, 1.0]))
    texts = ["word word other\nline 12", None, "", "é" * 10, "abc", "the the\tthe $$ 99 the ü", "x" * 3000, "\n\n a"]
    assert np.allclose(model.margin(texts), [slow_margin(t, model) for t in texts], atol=1e-5)
    tails = model.tails(np.array([0.5]))
    assert np.allclose(tails, [[1 / (1 + np.exp(-0.5)), 1 / (1 + np.exp(0.5))]])


def test_held_out(spark):
    import duckdb

    d = "/root/testdata/sf0.1"
    out = Q.judge_documents(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).collect()
    assert len(out) == 10_000
    good = dict(duckdb.sql(f"select doc_id, quality from '{d}/labels.parquet'").fetchall())
    import zlib

    held = [(r["keep"], good[r["doc_id"]]) for r in out if r["doc_id"] in good and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([k == g for k, g in held]) > 0.95
    assert all(0 <= r["tail_prob"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in out)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b", 3), (2, None, 3), (2, None, 3), (None, "", 3)], "doc_id long, text string, grade int")
    for rows in ([], [(1, 1, 0)], [(1, None, None), (2, 0, 1)]):
        out = Q.judge_documents(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()
        assert len(out) == 4 and all(0 <= r["tail_prob"] <= 1 for r in out)
    assert Q.judge_documents(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
