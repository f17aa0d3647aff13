"""Pieces: lossless round trips, the sampled distribution against all segmentations, edge rows."""

from collections import Counter

import numpy as np

from rowloom.llm import pieces as P


def segmentations(table, names, word):
    if not word:
        yield [], 1.0
    for n in range(1, min(len(word), table.longest) + 1):
        if word[:n] in names:
            i = names[word[:n]]
            for rest, weight in segmentations(table, names, word[n:]):
                yield [i, *rest], weight * table.weight[i]


def test_distribution():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    names = {m.id_to_piece(i): i for i in range(259, m.get_piece_size())}
    table = P.PieceTable(sharpness=0.4)
    ways = {tuple(ids): w for ids, w in segmentations(table, names, "▁theres")}
    total = sum(ways.values())
    n = 20_000
    ids, bounds = P.encode(table, ["theres"] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919))
    seen = Counter(tuple(ids[s:e].tolist()) for s, e in zip(bounds, bounds[1:], strict=False))
    assert set(seen) <= set(ways)
    for way, w in sorted(ways.items(), key=lambda x: -x[1])[:20]:
        assert abs(seen[way] / n - w / total) < 0.02, way


def test_rows(spark):
    texts = [None, "", " ", "  a  b\n\n\tc", "▁ ▁▁x", "日本\x00😀 naïve", "w" * 5000 + " end", "the cat sat " * 20_000, "the cat sat"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(8, texts[8], 1), (None, texts[8], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens int")
    out = P.sample_pieces(docs).collect()
    assert len(out) == len(rows) and all(r["lossless"] for r in out)
    got = {r["doc_id"]: r["tokens"] for r in out}
    assert got[0] is None and got[1] == []
    again = {r["doc_id"]: r["tokens"] for r in P.sample_pieces(docs.repartition(3), block=1000).collect()}
    assert got == again
    other = {r["doc_id"]: r["tokens"] for r in P.sample_pieces(docs, seed=1).collect()}
    assert other[7] != got[7]
    back = {r["doc_id"]: r["text"] for r in P.decode_pieces(P.sample_pieces(docs)).collect()}
    assert all(back[i] == t for i, t in enumerate(texts))
    assert P.sample_pieces(docs.limit(0)).count() == 0
