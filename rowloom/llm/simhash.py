"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within the radius of each other share a variant that lies within half the
radius of both. A fingerprint of 64 bits has 2,081 variants at two flips, so the ball is
hashed per half: of two fingerprints at 4 bits or fewer, one half differs in 2 bits or fewer,
and both emit a common variant of that half among its 33 variants at one flip. Fingerprints
are shuffled on (half, variant), colliding ones are compared over all 64 bits, and each
bucket yields a spanning set of its true links, at most one less than it has members. A
bucket of more than ``most`` fingerprints is first dealt on in the same manner by the half
that its key leaves open.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.common import WORD, spread_join, staged
from rowloom.llm.components import components

_WORDS = re.compile(WORD)
_LOWER = bytes(i + 32 if ord("A") <= i <= ord("Z") else i for i in range(256))


def shingle_hashes(text: str | None, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """Hashes of the whole text's word shingles, repeats included; none without words, one of the whole text where it is short."""
    words = _WORDS.findall(text or "")
    body = " ".join(words).encode("utf-8", "surrogatepass").translate(_LOWER)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(body, seed)] if words else [], dtype=">u8")
    gaps = np.flatnonzero(np.frombuffer(body, np.uint8) == 32).tolist()
    starts = [0, *[g + 1 for g in gaps]]
    ends = [*gaps, len(body)][shingle - 1 :]
    return np.array([digest(body[s:e], seed) for s, e in zip(starts, ends, strict=False)], dtype=">u8")


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bits that over half of the hashes have; 0 without any."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the whole text's word shingles, repeats included; 0 without words."""
    return fingerprint_of(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """Written table of doc_id and ``fp``, the fingerprint as a signed 64-bit number."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return staged(rows.mapInArrow(hashed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long"), "fingerprints")


def _spanning(bucket: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what the bucket's true links connect: a breadth-first walk over the fingerprints not yet reached."""
    found, left = [], bucket
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(np.bitwise_xor(left, at).view(np.uint64)) <= radius
            found += [(int(at), int(x)) for x in left[near]]
            queue += list(left[near])
            left = left[~near]
    return found


def half_variants(fps: DataFrame) -> DataFrame:
    """Every variant of either half at one flip or none: (key, fp); the key is the variant with the half's number above it."""
    halves = F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32)))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i) for i in range(32)])
    return fps.select("fp", F.explode(halves).alias("half")).select("fp", "half", F.explode(flips).alias("flip")).select("fp", F.col("half").bitwiseXOR(F.col("flip")).alias("key"))


def quarter_variants(crowded: DataFrame) -> DataFrame:
    """Variants of either 16-bit part of the half that a bucket's key leaves open, at one flip or none: (key, part, fp).

    Two members at 4 bits or fewer differ in one of these parts in 2 or fewer.
    """
    other = F.when(F.shiftrightunsigned("key", 32) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    parts = F.array(other.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(other, 16).bitwiseOR(F.lit(1 << 16)))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(16)])
    return crowded.select("key", "fp", F.explode(parts).alias("part")).select("key", "fp", "part", F.explode(flips).alias("flip")).select("key", F.col("part").bitwiseXOR(F.col("flip")).alias("part"), "fp")


def links(fps: DataFrame, most: int = 65_536, narrow: int = 500_000) -> DataFrame:
    """Links (a, b) between the different fingerprints of ``fps`` that connect all that lie within 4 bits, by chains at least.

    Buckets with one member go. The keys of the others are few; they reach the variants by
    broadcast where fewer than ``narrow`` of them were counted, else by a shuffle join. A
    bucket of more than ``most`` members is dealt on by variants of what its key leaves open,
    which loses no link. Each bucket yields a spanning set of its links.
    """
    variants = half_variants(fps)
    shared = staged(variants.groupBy("key").count().filter("count > 1"), "shared-keys")
    keys = shared.select(F.col("key").alias("_k"), "count")
    if shared.count() < narrow:
        keys = F.broadcast(keys)
    members = staged(variants.join(keys, F.col("key") == F.col("_k")).select("key", "fp", "count"), "bucket-members")
    buckets = members.filter(F.col("count") <= most).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    crowded = members.filter(F.col("count") > most)
    if not crowded.isEmpty():
        buckets = buckets.union(quarter_variants(crowded).groupBy("key", "part").agg(F.collect_list("fp").alias("fps")).select("fps"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("fps")
            flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            offsets = offsets - offsets[0]
            found = [pair for s, e in itertools.pairwise(offsets) for pair in _spanning(np.sort(flat[s:e]), 4)]
            a, b = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else ((), ())))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return buckets.mapInArrow(verified, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``fp`` and component_id, the smallest doc_id that links reach.

    Documents link where their fingerprints differ in 4 bits or fewer. A null text counts as an
    empty one; texts without words have fingerprint zero and link like any other. Null doc_ids
    rank last; a group of them alone has a null component_id. Repeated rows each get a row.
    Other columns are ignored. Empty input gives no rows.
    """
    prints = fingerprints(docs, doc_id, text, shingle)
    fps = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")), "distinct-fingerprints")
    labels = components(links(fps.select("fp")))
    joined = staged(fps.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "low", "copies", F.coalesce("label", "fp").alias("label")), "labelled-fingerprints")
    lows = joined.groupBy("label").agg(F.min("low").alias("component_id"), F.count("*").alias("members"))
    # one text's copies, and one component's fingerprints, are dealt to several tasks
    of_fp = spread_join(joined, lows, ["label"], "members", F.col("fp")).select("fp", "copies", "component_id")
    return spread_join(prints, of_fp, ["fp"], "copies", F.col("doc_id")).select("doc_id", "fp", "component_id")


def row_key(docs: DataFrame) -> Column:
    """A struct of doc_id and ``row``, a hash that tells rows apart; nulls count, which xxhash64 alone passes over."""

    def value(field: T.StructField) -> Column:
        at = F.col("`" + field.name.replace("`", "``") + "`")
        nested = isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType | T.VariantType)
        return F.to_json(F.struct(at.alias("v")), {"ignoreNullFields": "false"}) if nested else at

    values = [value(f) for f in docs.schema]
    return F.struct("doc_id", F.xxhash64(*[v.isNull() for v in values], *values).alias("row"))


def keep_one(docs: DataFrame, shingle: int = 5, near=near_duplicates) -> DataFrame:
    """``docs`` with one document of each group, that with the smallest doc_id (null first), and one of rows that are alike; ``near`` finds the groups."""
    keyed = docs.withColumn("_rl_row", row_key(docs))
    found = near(keyed, doc_id="_rl_row", shingle=shingle)
    first = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_rl_first")).distinct()
    kept = keyed.join(first, F.col("_rl_row") == F.col("_rl_first"), "left_semi")
    return kept.dropDuplicates(["_rl_row"]).drop("_rl_row")
