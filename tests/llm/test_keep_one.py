"""One document of each group stays, whatever columns are null and whatever ids repeat."""

import random

import pytest

import corpus_pipeline
from rowloom.llm import simhash

TEXTS = [None, "", "en", "de", "a b c d e f g", "one two three four five six", "x y z"]


def survivors(rows):
    """The smallest doc_id (null first) of each group; of these texts only equal ones and those without words are alike."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append((r[0] is not None, r[0] or 0))
    return sorted((text, min(ids)) for text, ids in groups.items())


def test_nulls_tell_rows_apart(spark):
    """A value that moves into another column's null is another row: no group loses all its documents."""
    rnd = random.Random(2)
    rows = [(1, None, "en", "s"), (1, "en", None, "s"), (2, "x y z", None, None), (2, None, "x y z", None)]
    rows += [(rnd.choice([None, 1, 2, 3]), rnd.choice(TEXTS), rnd.choice([None, "en", "de", "x y z"]), rnd.choice([None, "en", "de"])) for _ in range(80)]
    for some in (rows[:2], rows[2:4], rows):
        docs = spark.createDataFrame(some, "doc_id long, text string, lang string, source string")
        for kept in (corpus_pipeline.dedup_near(spark, docs, ""), simhash.keep_one(docs)):
            got = [tuple(r) for r in kept.collect()]
            assert set(got) <= set(some)
            assert sorted((r[1] or "", (r[0] is not None, r[0] or 0)) for r in got) == survivors(some)


@pytest.mark.parametrize(
    ("kind", "a", "b"),
    [("array<string>", ["en"], [None]), ("struct<x:string,y:string>", ("en", None), (None, None)), ("map<string,string>", {"k": "en"}, {"k": None})],
)
def test_nested_columns(spark, kind, a, b):
    docs = spark.createDataFrame([(1, None, a), (1, "en", b), (2, "en", a), (3, "de", None)], f"doc_id long, text string, `more.of it` {kind}")
    kept = corpus_pipeline.dedup_near(spark, docs, "")
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == [(1, ""), (1, "en"), (3, "de")]
