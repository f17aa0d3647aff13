"""The pipeline: stages in order, each stage's effect, against a plain version where that is short."""

import os

from pyspark.sql import functions as F

import corpus_pipeline
from rowloom.llm import common


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").cache()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "simhash near-dedup", "mixing", "sentencepiece"]
    clean = corpus_pipeline.drop_toxic(spark, docs, d)
    assert clean.columns == docs.columns and 0 < clean.count() <= docs.count()
    lines = corpus_pipeline.dedup_lines(spark, docs, d)
    assert lines.columns == docs.columns and lines.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    near = corpus_pipeline.dedup_near(spark, docs, d)
    assert near.columns == docs.columns and 0 < near.count() < docs.count()
    mixed = corpus_pipeline.mix_sources(spark, docs, d)
    assert mixed.columns == docs.columns


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "tokens", "n_tokens", "lossless"] and out.filter("n_tokens > 0").count() > 0
    assert out.filter("not lossless").count() == 0
    # copies of one document are sampled anew
    copies = out.filter("n_tokens > 200").groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("tokens").alias("different")).filter("n > 1")
    assert copies.count() > 0 and copies.filter("different < n").count() == 0


ODD = [
    (1, "a b c d e f g h", "en", "s", 15, "own", 7, 9),
    (1, "a b c d e f g h", "en", "s", 15, "own", 7, 9),
    (2, "A b c d e f g h", None, None, None, None, None, None),
    (3, None, "en", "s", 0, "x", 1, 1),
    (4, "", "en", None, 0, "x", 1, 1),
    (None, " \n\n \n", "en", "s", 5, "x", 1, 1),
    (None, "one\ntwo\nthree\nfour", "en", "t", 18, "x", 1, 1),
    (5, "one\ntwo\nthree\nfour", "en", "t", 18, "x", 1, 1),
    (6, "zero\none\ntwo\nthree", "en", "t", 18, "x", 1, 1),
    (7, "long " * 200_000, "en", "t", 1_000_000, "x", 1, 1),
]


def test_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, clashing names, empty tables: what each stage leaves of them."""
    d = "/root/testdata/sf0.001"
    names = "doc_id long, text string, lang string, source string, n_chars long, size string, n_lines int, n_removed int"
    docs = spark.createDataFrame(ODD, names)
    key = lambda r: tuple((v is not None, v) if not isinstance(v, str) else (True, v[:40]) for v in r)

    def after(stage, of=docs):
        out = stage(spark, of, d)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        return sorted(map(tuple, out.collect()), key=key)

    whole = sorted(ODD, key=key)
    assert after(corpus_pipeline.drop_toxic) == whole
    # the null doc_id comes first and keeps its lines; 5 loses all and goes, 6 keeps its first line
    want = [r if r[0] != 6 else (6, "zero", "en", "t", 4, "x", 1, 1) for r in ODD if r[0] != 5]
    assert after(corpus_pipeline.dedup_lines) == sorted(want, key=key)
    # 3, 4 and the blank null are one group, 1, 1 and 2 another, null and 5 a third
    near = after(corpus_pipeline.dedup_near)
    assert sorted((r[0] is not None, r[0] or 0, (r[1] or "")[:5]) for r in near) == [(False, 0, " \n\n \n"[:5]), (False, 0, "one\nt"), (True, 1, "a b c"), (True, 6, "zero\n"), (True, 7, "long ")]
    mixed = after(corpus_pipeline.mix_sources)
    assert set(mixed) <= set(ODD) and len(mixed) >= len(ODD) // 2
    pieces = {(r["doc_id"], r["n_tokens"] > 0, r["tokens"] is None, r["lossless"]) for r in corpus_pipeline.encode(spark, docs, d).collect()}
    assert (3, False, True, True) in pieces and (4, False, False, True) in pieces and all(p[3] for p in pieces)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), d).count() == 0
    bare = docs.select("doc_id", "text", "source")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, bare, d).columns == bare.columns


def test_scratch_goes(spark, monkeypatch, tmp_path):
    """Intermediate tables are gone when their stage is written."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    with common.scratch(spark):
        assert common.staged(spark.range(5), "numbers").count() == 5 and len(os.listdir(tmp_path)) == 1
    assert os.listdir(tmp_path) == []
