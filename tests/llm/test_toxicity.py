"""Toxicity: the kernel against its definition, gapped insults, held-out accuracy, edge rows."""

import itertools
import random

import numpy as np

from rowloom.llm import toxicity as T


def slow_kernel(a, b):
    def triples(w):
        codes, _ = T.letter_codes([w])
        codes = codes[0][codes[0] > 0]
        out, norm = {}, 0.0
        for i, j, k in itertools.combinations(range(len(codes)), 3):
            if k - i <= T.SPAN:
                key, weight = (codes[i] << 12) | (codes[j] << 6) | codes[k], T.DECAY ** (k - i - 2)
                out[key] = out.get(key, 0) + weight
                norm += weight**2
        return {t: v / norm**0.5 for t, v in out.items()}

    x, y = triples(a), triples(b)
    return sum(v * y.get(t, 0) for t, v in x.items())


def test_kernel():
    words, marks = ["idiot", "idxiot", "été", "a" * 20, "stupidly"], ["idiot", "stupid", "aaaa"]
    got, known, values = T.landmark_features(words, marks)
    want = [[slow_kernel(w, m) for m in marks] for w in words]
    assert np.allclose(got, want, atol=1e-5)
    # folded into one weight per triple the kernel's sum is the same, with an offset and between the bounds
    alpha = np.array([0.5, -1.0, 2.0])
    table = np.zeros((1 << 18) + 1, np.float32)
    table[known], table[-1] = values @ alpha, 0.25
    assert np.allclose(T.word_scores(words, table), np.clip(np.array(want) @ alpha + 0.25, -1, T.CEILING), atol=1e-4)


def test_letters_put_in():
    for count in (1, 2):
        made = T.with_letters("idiot", count, 20, "xyzé")
        assert made == T.with_letters("idiot", count, 20, "xyzé") and len(set(made)) > 5
        for m in made:
            left = iter(m)
            assert len(m) == 5 + count and all(c in left for c in "idiot")


def test_tokens():
    assert T.parts_of("St*pid!") == ["stpid"] and T.parts_of("1d10t") == ["idiot"] and T.parts_of("a.b") == [] and T.parts_of("one,two") == ["one", "two"]
    assert "idiot" in T.tokens_of("you i d i o t there") and T.parts_of("i.d.i.o.t") == ["idiot"]
    assert T.tokens_of(None) == set() == T.tokens_of("")


def test_scores(spark):
    import duckdb

    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = T.fit(docs, labels)
    extra = [(1, "the idiot and moron", "x"), (2, "plain words of the that", "x"), (3, None, "x"), (4, "", "x"), (None, "the id-iot", "x"), (6, "i d i o t and m o r o n", "x"), (7, "of the and idxiot with", "x"), (8, "of the " * 50_000 + "idiot", "x"), (9, "z" * 100_000, "x"), (9, "z" * 100_000, "x")]
    got = {r["doc_id"]: r["score"] for r in model.score(spark.createDataFrame(extra, "doc_id long, text string, score string")).collect()}
    assert got[1] > 0.7 and got[None] > 0.7 and got[6] > 0.7 and got[8] > 0.7
    assert got[7] > 0.7
    # insults with one or two letters put in, letters that no training has drawn, in clean held-out texts
    insults = ["trash", "pathetic", "idiot", "worthless", "disgusting", "stupid", "clown", "loser", "scum", "moron"]
    rnd = random.Random(4)

    def disguised(word, count):
        for _ in range(count):
            at = rnd.randint(1, len(word) - 1)
            word = word[:at] + rnd.choice("abcdefghijklmnopqrstuvwxyz") + word[at:]
        return word

    plain = docs.join(labels.filter("toxic = 0"), "doc_id").filter(T.held_out(docs["doc_id"]) & (docs["lang"] == "en") & (docs["n_chars"] < 2000))
    plain = [r["text"] for r in plain.select("text").orderBy("doc_id").limit(40).collect()]
    made = [(f"{count} {times}", f"{text} " + " ".join(disguised(rnd.choice(insults), count) for _ in range(times))) for count in (0, 1, 2) for times in (1, 3) for text in plain]
    made += [("clean", text) for text in plain]
    caught = {}
    for r in model.score(spark.createDataFrame(made, "doc_id string, text string")).collect():
        caught.setdefault(r["doc_id"], []).append(r["score"] >= 0.7)
    caught = {k: np.mean(v) for k, v in caught.items()}
    assert caught["clean"] == 0
    assert min(caught["0 1"], caught["0 3"], caught["1 3"], caught["2 3"]) >= 0.95 and caught["1 1"] >= 0.9 and caught["2 1"] >= 0.5, caught
    assert got[2] < 0.3 and got[3] == got[4] < 0.3
    rows = T.score_documents(docs, labels).collect()
    assert len(rows) == 10_000
    toxic = dict(duckdb.sql(f"select doc_id, toxic from '{d}/labels.parquet'").fetchall())
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert np.mean([p == t for p, t in held]) > 0.98
    assert sum(p == t == 1 for p, t in held) >= 120 and sum(p > t for p, t in held) <= 5


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, 1, 0)], [(1, None, 0)], [(5, 0, 1), (1, 0, 1)]):
        out = T.score_documents(docs, spark.createDataFrame(rows, "doc_id long, toxic int, quality int")).collect()
        assert len(out) == 2 and all(0 <= r["score"] <= 1 for r in out)
    assert T.score_documents(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
