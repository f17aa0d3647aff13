"""A corpus pipeline of five stages; each is written as Parquet and reread as the next one's input.

Toxic documents go, repeated line windows go, near duplicates go but for one of each group,
the sources are mixed to their target weights, and what is left is encoded.

All stages take ``doc_id``, ``text`` and ``source``, pass other columns through (whatever
their names) and accept null values in every column, texts of any length, repeated rows and
empty tables, which give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.llm import jaccard, lines, mixing, pieces, simhash, toxicity
from rowloom.llm.common import delete, scratch, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't predict toxic.

    A null text counts as an empty one; repeated rows are judged alike. Labels are learned from
    rows of ``labels`` whose document is in ``docs`` and not held out; without any, all stay.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return model.append(docs, name="_rl_score").filter("_rl_score < 0.7").drop("_rl_score")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows removed; documents that lose every line go.

    ``n_chars``, where there is one, follows the new text. Null texts, empty ones and texts under three lines stay.
    Rows that agree in doc_id and text count as one document and lose the same lines.
    """
    mine = {c: f"_rl_own_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    out = lines.dedup_lines(docs.withColumnsRenamed(mine)).filter("n_removed = 0 or n_removed < n_lines")
    if "n_chars" in docs.columns:
        n_chars: Column = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return out.drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in mine.items()}).select(docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: a Jaccard similarity of 0.8 or more over five-word shingles.

    Fingerprints in one ball are verified by that similarity, and a prefix filter finds the
    pairs that lie beyond the ball. The smallest doc_id of a group stays, null before all; of rows that are alike one
    stays. Texts without words, null ones too, are one group.
    """
    return simhash.keep_one(docs, near=jaccard.near_duplicates)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights, documents repeated where a source needs a second epoch.

    A null source is one of its own; a document without words comes once for each whole epoch of its source.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each document, decoded again to see that nothing is lost.

    Copies of a document are numbered, and the number is part of the seed, so that each epoch
    sees other samples. A null text has null pieces.
    """
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    numbered = docs.select("doc_id", "text", F.row_number().over(same).alias("copy"))
    keyed = numbered.select("doc_id", "text", F.concat_ws(":", F.col("doc_id").cast("string"), "copy").alias("key"))
    return pieces.sample_pieces(keyed, key="key")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_near),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Trained models and sampled pieces are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; what a stage has read goes as soon as its own result is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{folder}/{number}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{number}")
        if number:
            delete(spark, f"{folder}/{number - 1}")
    return docs
