"""SimHash components against all pairs; crowded buckets against whole ones."""

import random

import xxhash

from rowloom.llm import simhash


def slow_fingerprint(text):
    import re

    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    low = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return [low[find(i)] for i in range(len(fps))]


def test_components(spark):
    rnd = random.Random(3)
    words = [f"W{i}É" for i in range(500)]
    base = [[rnd.choice(words) for _ in range(rnd.choice([1, 3, 4, 5, 80, 400]))] for _ in range(40)]
    texts = [None, "", " \n\t", " ", "a b c d"]
    for b in base:
        for _ in range(rnd.randint(1, 6)):
            c = list(b)
            c[rnd.randrange(len(c))] = rnd.choice(words)
            texts.append(" ".join(c))
    texts.append("x " * 50_000)
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(3, texts[7], 0), (3, texts[7], 0), (None, texts[9], 0), (None, "alone here", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    want_fp = [slow_fingerprint(t) for _, t, _ in rows]
    want = slow_components([r[0] for r in rows], want_fp)
    got = simhash.near_duplicates(docs).collect()
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got), key=key) == sorted(zip([r[0] for r in rows], want_fp, want, strict=True), key=key)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_crowded_buckets(spark):
    """Chains through crowded buckets: dealt on by the open half, they link the same groups."""
    rnd = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):
        at = rnd.getrandbits(64)
        for _ in range(60):
            fps.add(at)
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                at ^= 1 << b
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    frame = spark.createDataFrame(signed, "fp long")
    want = slow_components([s[0] for s in signed], fps)
    for most in (2, 256):
        labels = {r["node"]: r["label"] for r in simhash.components(simhash.links(frame, most=most)).collect()}
        assert [labels.get(s[0], s[0]) for s in signed] == want, most
    labels = {r["node"]: r["label"] for r in simhash.components(simhash.links(frame, narrow=0)).collect()}
    assert [labels.get(s[0], s[0]) for s in signed] == want


def test_copies_and_components_are_dealt(spark, monkeypatch):
    """Keys of very many rows go to several tasks, with the same result."""
    from rowloom.llm import common

    rows = [(i, "one text that many documents hold") for i in range(300)] + [(300 + i, f"text number {i} of its own") for i in range(20)] + [(400 + i, None) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(tuple(r) for r in simhash.near_duplicates(docs).collect())
    monkeypatch.setattr(common.spread_join, "__defaults__", (7,))
    assert sorted(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    assert {r[2] for r in want if r[0] < 300} == {0} and {r[2] for r in want if r[0] >= 400} == {400}
