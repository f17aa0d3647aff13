"""Mixing and line dedup: budgets, repeats, edge rows."""

from collections import Counter

from rowloom.llm import lines, mixing


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 500), ("c", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    want, weights = {}, {"a": 3, "b": 1, "c": 2, None: 3}
    limits = {"a": 20, "b": 2000, "c": 0, None: 1000}
    budget, left = 1.5 * 1510, dict(weights)
    while True:  # share, stop who is above, share the rest again
        level = (budget - sum(want.values())) / sum(left.values())
        above = [s for s in left if left[s] * level > limits[s]]
        if not above:
            break
        for s in above:
            want[s] = limits[s]
            del left[s]
    want |= {s: w * level for s, w in left.items()}
    assert {s: round(t, 6) for s, t in got.items()} == {s: round(t, 6) for s, t in want.items()}


def test_mix(spark):
    rows = [(i, "w " * (i % 7), "hot" if i % 3 else f"s{i % 5}", i) for i in range(400)] + [(None, None, None, 0), (5, "a b", "hot", 1), (5, "a b", "hot", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    taken, target = Counter(), {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert mixing.mix(docs.limit(0)).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0


def dedup(spark, rows):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_lines int")
    return {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()}


def test_lines(spark):
    got = dedup(spark, [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "b\nc\nd\nz"), (4, "a\nb"), (5, None), (6, ""), (7, "q\nq\nq\nq\nq"), (8, "\n\n\n\n"), (9, "\n\n\n\n")])
    assert got == {1: "a\nb\nc\nd", 2: "x\ny", 3: "z", 4: "a\nb", 5: None, 6: "", 7: "q", 8: "\n\n\n\n", 9: "\n\n\n\n"}


def test_repeated_rows_and_long_text(spark):
    long = "\n".join(f"line {i}" for i in range(30_000))
    docs = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, long), (3, long)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in lines.dedup_lines(docs).collect())
    assert got == Counter({(None, "a\nb\nc"): 1, (1, ""): 2, (2, long): 1, (3, ""): 1})
    assert lines.dedup_lines(docs.limit(0)).count() == 0
