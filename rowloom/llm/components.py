"""Connected components of a link table by local spanning forests and contraction, on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import staged


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b), in order, and the smallest node that each reaches by them.

    Minimum labels over the links with pointer jumping, all links at once.
    """
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    low = np.arange(len(nodes))
    while len(x):
        np.minimum.at(low, np.maximum(low[x], low[y]), np.minimum(low[x], low[y]))
        while True:
            up = low[low]
            if (up == low).all():
                break
            low = up
        open_ = low[x] != low[y]
        x, y = x[open_], y[open_]
    return nodes, nodes[low]


def forest(links: DataFrame) -> DataFrame:
    """Of each partition's links the star forest (child, root): fewer rows than the partition has nodes, the same connections."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        child, root = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def shrink() -> tuple[np.ndarray, np.ndarray]:
            a, b = (np.concatenate(p) for p in zip((child, root), *held, strict=True))
            nodes, low = roots_of(a, b)
            return nodes[nodes != low], low[nodes != low]

        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            waiting += batch.num_rows
            if waiting > max(1 << 18, len(child)):
                child, root = shrink()
                held, waiting = [], 0
        child, root = shrink()
        for s in range(0, len(child), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(child[s : s + (1 << 16)]), pa.array(root[s : s + (1 << 16)])], ["child", "root"])

    return links.mapInArrow(reduced, "child long, root long")


def components(links: DataFrame, at_once: int = 250_000, least: int = 8) -> DataFrame:
    """(node, label) for every node of ``links`` (long columns a, b): label is the smallest node that links reach.

    Each round deals the links at random to tasks of about ``at_once``, ``least`` tasks at
    least, and a task leaves only a spanning forest of its share. A node that is no root in any
    share is done: it follows its smallest root, and its other roots link to that one. What
    goes on to the next round is links between roots alone, shortened by a jump to the root's
    own root, until none is left. Every round's rows are a written table, their number falls
    from round to round, and no task holds all links of a node. At the end labels go back
    down from round to round. Links of a node to itself count for nothing.
    """
    now, followers = staged(forest(links.filter("a <> b").select("a", "b")), "forest"), []
    while left := now.count():
        dealt = now.select(F.col("child").alias("a"), F.col("root").alias("b")).repartition(max(least, -(-left // at_once)), "a", "b")
        now = staged(forest(dealt), "forest")
        is_root = now.select(F.col("root").alias("_r")).distinct()
        lows = now.groupBy("child").agg(F.min("root").alias("low")).join(is_root, F.col("child") == F.col("_r"), "left")
        lows = staged(lows.select("child", "low", F.col("_r").isNotNull().alias("inner")), "low-roots")
        followers.append(lows.filter("not inner").select(F.col("child").alias("node"), "low"))
        jumps = lows.filter("inner").select(F.col("child").alias("_c"), F.col("low").alias("_up"))
        inner = lows.filter("inner").join(jumps, F.col("low") == F.col("_c"), "left").select("child", F.coalesce("_up", "low").alias("root"))
        others = now.join(lows.select(F.col("child").alias("_c"), "low"), F.col("child") == F.col("_c")).filter("root <> low")
        now = staged(others.select(F.col("root").alias("child"), F.col("low").alias("root")).union(inner).distinct(), "forest")
    if not followers:
        return now.select(F.col("child").alias("node"), F.col("root").alias("label"))
    labels = followers[-1].select("node", F.col("low").alias("label"))
    for level in reversed(followers[:-1]):
        up = labels.select(F.col("node").alias("_n"), "label")
        found = level.join(up, F.col("low") == F.col("_n"), "left").select("node", F.coalesce("label", "low").alias("label"))
        labels = staged(labels.union(found), "labels")
    roots = labels.select("label").distinct()
    return labels.union(roots.select("label", "label"))
