"""Near duplicates of the pipeline against all pairs at a similarity of 0.8."""

import random

import pyarrow.parquet as pq

import corpus_pipeline
from rowloom.llm import jaccard


def slow_kept(texts):
    """Ids of the smallest of each group that links at 0.8 reach; sets of word tuples, all pairs."""

    def shingles(text):
        words = [w.lower() for w in text.split()]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in range(len(texts)) if find(i) == i}


def made_texts():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    line = " ".join(rnd.choice(words) for _ in range(12))
    texts = ["", "a b c", "A b c", "a b c d e"]
    for _ in range(40):
        base = [rnd.choice(words) for _ in range(rnd.choice([6, 12, 30, 90, 400]))]
        for _ in range(rnd.randint(1, 5)):
            c = list(base)
            for _ in range(rnd.randint(0, max(1, len(c) // 40))):
                c[rnd.randrange(len(c))] = rnd.choice(words)
            texts.append(" ".join([*c[: rnd.choice([len(c), len(c), len(c) * 9 // 10])], *([line] if rnd.random() < 0.3 else [])]))
    return texts


def test_all_pairs(spark):
    texts = made_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = slow_kept(texts)
    assert 20 < len(want) < len(texts) - 20
    assert {r["doc_id"] for r in corpus_pipeline.dedup_near(spark, docs, "").collect()} == want
    # a shuffle instead of the broadcast; groups cut into many parts
    for options in ({"narrow": 0}, {"at_once": 60}, {"at_once": 500}):
        found = jaccard.near_duplicates(docs, **options)
        assert {r["doc_id"] for r in found.filter("doc_id = component_id").collect()} == want, options
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_given_table(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    rows = sorted(pq.read_table(path, columns=["doc_id", "text"]).to_pylist(), key=lambda r: r["doc_id"])
    want = {rows[i]["doc_id"] for i in slow_kept([r["text"] for r in rows])}
    got = {r["doc_id"] for r in corpus_pipeline.dedup_near(spark, spark.read.parquet(path), "").collect()}
    assert got == want
