"""Periodic runs of words by a dictionary of basic factors.

At every power of two L the factors of L words of a document get names, made of the names of
their halves. A run of smallest period q has, for the L with L / 2 < q <= L, at each of its
positions but the last ones the next equal factor exactly q words on: a nearer one would give
the run a smaller period, as two periods of a factor at least as long as both have their
greatest common divisor as a period. So successors more than half the length and at most the length away (twice the
length would only propose the same periods again) that stand at one distance at consecutive
positions are the arithmetic progressions of one run; extended by the factor's own length, such
a stretch is the whole run, and every run is found at one level and once.

Documents of a block are named side by side as arrays. Positions whose factor stands once in
its document can't start a repeated longer factor and leave, so that higher levels hold little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import WORD


def runs_of(words: np.ndarray, doc: np.ndarray, ends: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run, ordered by start and period, over concatenated documents.

    words: word numbers; doc: the document of each word; ends: where each document ends. A run has
    ``least`` words and ``times`` periods at least; ``times`` has to be 3 or more.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = len(words)
    at = np.arange(n)
    key = words.astype(np.int64) + doc.astype(np.int64) * (int(words.max(initial=0)) + 1)
    length = 1
    while len(at):
        order = np.argsort(key, kind="stable")  # equal names stay in order of position
        ranked, places = key[order], at[order]
        new = np.ones(len(at), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        repeats = ~new
        repeats[:-1] |= ~new[1:]
        name = np.full(n, -1, np.int64)  # of the factor at each position that stands in its document again
        name[places[repeats]] = np.cumsum(new)[repeats]
        step = np.zeros(n, np.int64)  # to the next equal factor, 0 for none
        same = np.flatnonzero(~new[1:])
        step[places[same]] = places[same + 1] - places[same]
        step[(step * 2 <= length) | (step > length)] = 0
        hit = np.flatnonzero(step)
        if len(hit):
            first = np.ones(len(hit), bool)
            first[1:] = (np.diff(hit) > 1) | (step[hit[1:]] != step[hit[:-1]]) | (doc[hit[1:]] != doc[hit[:-1]])
            starts = np.flatnonzero(first)
            lasts = np.append(starts[1:], len(hit)) - 1
            start, period = hit[starts], step[hit[starts]]
            size = hit[lasts] - start + length + period
            long_enough = size >= np.maximum(least, times * period)
            found.append((start[long_enough], size[long_enough], period[long_enough]))
        # a factor twice as long: both halves stand in the document again, and it ends inside it
        at = np.flatnonzero(name >= 0)
        at = at[at + 2 * length <= ends[doc[at]]]
        at = at[name[at + length] >= 0]
        key = name[at] * (n + 1) + name[at + length]
        length *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, size, period = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], size[order], period[order]


RUNS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 24, times: int = 3, block: int = 500_000) -> DataFrame:
    """doc_id, ``n_words``, ``runs`` and ``collapsed`` of every row.

    runs: start (word number), length and smallest period of every maximal stretch of ``least``
    words and ``times`` periods (3 or more) at least, by start, then period. collapsed: the words,
    joined by one space, less those that a run holds after its first period. A null text counts
    as an empty one; repeated rows each get their result; other columns are ignored; an empty
    table gives no rows. ``block`` bounds the words that are compared at once, but for a longer single text.
    """
    if times < 3:
        raise ValueError("a run has to hold three periods")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def searched(texts: list[list[bytes]]) -> tuple[list[int], list[list[dict]], list[str]]:
        counts = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(counts)
        doc = np.repeat(np.arange(len(texts)), counts)
        flat = pa.array([w for t in texts for w in t], pa.binary())
        numbers = flat.dictionary_encode().indices.to_numpy()
        start, size, period = runs_of(numbers, doc, ends, least, times)
        of, begin = doc[start], (ends - counts)[doc[start]]
        out: list[list[dict]] = [[] for _ in texts]
        cover = np.zeros(len(flat) + 1, np.int64)
        np.add.at(cover, start + period, 1)
        np.add.at(cover, start + size, -1)
        kept = np.cumsum(cover)[:-1] == 0
        for d, s, n, p in zip(of.tolist(), (start - begin).tolist(), size.tolist(), period.tolist(), strict=True):
            out[d].append({"start": s, "length": n, "period": p})
        joined = []
        for t, found, end in zip(texts, out, ends.tolist(), strict=True):
            words = [w for w, k in zip(t, kept[end - len(t) : end].tolist(), strict=True) if k] if found else t
            joined.append(b" ".join(words))
        return counts.tolist(), out, joined

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = 0
            while s < len(batch):
                texts, words, e = [], 0, s
                while e < len(batch) and (e == s or words < block):
                    texts.append(batch.column("text")[e].as_py().split())  # bytes split where the contract's words do
                    words += len(texts[-1])
                    e += 1
                counts, found, joined = searched(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s, e - s), pa.array(counts, pa.int64()), pa.array(found, _RUN), pc.cast(pa.array(joined, pa.binary()), pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
                s = e

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {RUNS}")


def strongest(runs: Column) -> Column:
    """The run of greatest length over period, compared as exact fractions; of equals the first. Null for none."""

    def better(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    return F.reduce(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where about a tenth of the documents, told by their id's checksum, repeat a stretch of their words up to the end."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    marked = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    g = F.floor(F.col("h") / 10)
    marked = marked.withColumn("a", F.when(F.col("n") > 0, g % F.col("n")).cast("int"))
    rest = F.col("n") - F.col("a")
    marked = marked.withColumn("p", (1 + F.floor(rest / (3 + g % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), rest)), " ")
    return marked.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))
