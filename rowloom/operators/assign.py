"""Unique assignment: rows take candidates by falling quality, each candidate once in its group.

One after the other a group's best safe row takes its best free candidate, and the gaps and
qualities of the rest are made anew. Here many rows take theirs in one round: a row that is safe
and whose best candidate no other row can still use takes it at any time with the same outcome,
as nothing that it changes is looked at by others; and the best row of a group is the one that comes
next anyhow. Rows that can no longer become safe are left out, which frees more candidates of
rivals, so rounds are far fewer than rows.

Groups are shuffled once, whole, and go through all their rounds in their task, many of them
together. A group of very many candidates stands in no single task: its rounds are jobs of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from rowloom.operators.written import work_folder, written

#: Least score, agreeing facts and gap of the three plain rules (fixed values).
SAFE = ((0.72, 0, 0.035), (0.67, 1, 0.04), (0.64, 2, 0.045))
#: Candidates that a task puts through their rounds together, at least.
TOGETHER = 100_000


def least_gap(score: Column, meta: Column, agreed: Column, read: Column) -> Column:
    """The least gap with which a best free candidate may be taken, null for none; agreed: how many sources support the row's candidate, read: whether a reading names this one."""
    rules = [((score >= s) & (meta >= m), g) for s, m, g in SAFE]
    rules.append(((agreed >= 2) & (score >= 0.62) & (meta >= 1), 0.025))
    rules.append((read & (score >= 0.66) & (meta >= 1), 0.025))
    return F.least(*[F.when(holds, F.lit(g)) for holds, g in rules])


def assign_unique(candidates: DataFrame, taken: DataFrame | None = None, large: int = 20_000) -> DataFrame:
    """Assignments: group, row, uid, score, round.

    candidates: group, row (their order breaks ties), uid, score, meta, agreed, read; a row holds a
    uid once, and null counts as 0 or false. ``taken``: group and uid of candidates that are used beforehand.
    A row's candidates rank by score, of equals the smaller uid first; quality is score plus 0.45 of the gap to the
    next free one (to 0 for none) plus 0.015 for each agreeing fact, to nine decimals. Each round at
    least assigns the best safe row of every group that has one. Groups of more than ``large``
    candidates are assigned by one job a round. group, row and uid are of plain types.
    """
    score = F.col("score").cast("double")
    meta, agreed, read = F.coalesce("meta", F.lit(0)), F.coalesce("agreed", F.lit(0)), F.coalesce("read", F.lit(False))
    kinds = candidates.schema
    # a candidate without a least gap is never taken, but stands as a rival behind others
    free = candidates.filter("score is not null").select("group", "row", "uid", score.alias("score"), (meta * 0.015).alias("bonus"), least_gap(score, meta, agreed, read).alias("least"))
    if taken is not None:  # as rows without a score
        nothing = {c: F.lit(None).cast(free.schema[c].dataType) for c in ("row", "score", "bonus", "least")}
        free = free.unionByName(taken.select("group", "uid").distinct().withColumns(nothing))
    free = written(free, "candidates")
    wide = written(free.groupBy(F.col("group").alias("_g")).agg(F.count("*").alias("_n")).filter(F.col("_n") > large).select("_g"), "large-groups")
    if wide.isEmpty():
        found = _in_tasks(free)
    else:
        same = F.col("group").eqNullSafe(F.col("_g"))
        found = _in_tasks(free.join(F.broadcast(wide), same, "left_anti")).unionByName(_in_jobs(free.join(F.broadcast(wide), same, "left_semi")))
    return found.select(*[F.col(c).cast(kinds[c].dataType).alias(c) for c in ("group", "row", "uid")], "score", "round")


def _in_tasks(free: DataFrame) -> DataFrame:
    """Assignments of groups that fit a task each."""
    whole = free.repartition("group").sortWithinPartitions("group", "row", F.col("score").desc(), "uid")
    schema = StructType([whole.schema[c] for c in ("group", "row", "uid", "score")]).add("round", IntegerType())

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= TOGETHER:
                rows = pa.Table.from_batches(held)
                last = int(np.flatnonzero(np.diff(_codes(rows["group"]), prepend=-1))[-1])
                yield from _rounds(rows.slice(0, last)).to_batches()
                held, n = rows.slice(last).combine_chunks().to_batches(), n - last
        if n:
            yield from _rounds(pa.Table.from_batches(held)).to_batches()

    return whole.mapInArrow(assigned, schema)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each different value, null among them."""
    return pc.dictionary_encode(column.combine_chunks(), null_encoding="encode").indices.to_numpy().astype(np.int64)


def _nine(x: np.ndarray) -> np.ndarray:
    """To nine decimals as Spark rounds: halves of the shortest decimal form go up."""
    small = np.abs(x) < 2.0**53  # others are whole numbers
    shifted = np.where(small, x, 0.0) * 1e9
    out = np.where(small, np.rint(shifted) / 1e9, x)
    half = np.abs(shifted - np.floor(shifted) - 0.5) < 1e-6 + np.abs(shifted) * 1e-15
    for i in np.flatnonzero(half):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    return out


def _rounds(rows: pa.Table) -> pa.Table:
    """All rounds of whole groups, sorted by group, row, falling score and uid; rows without a score name what is used beforehand."""
    group, row, uid = (_codes(rows[c]) for c in ("group", "row", "uid"))
    score, bonus, least = (rows[c].to_numpy() for c in ("score", "bonus", "least"))
    can, used = rows["least"].is_valid().to_numpy(), rows["score"].is_null().to_numpy()
    unnamed = rows["uid"].is_null().to_numpy() & ~used
    uid[unnamed] = len(uid) + np.flatnonzero(unnamed)  # no two of these are the same
    row = np.cumsum((np.diff(group, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    pair = np.unique(group * 2 * max(1, len(uid)) + uid, return_inverse=True)[1]
    gone_pair, gone_row = np.zeros(len(pair), bool), np.zeros(len(row) + 1, bool)
    gone_pair[pair[used]] = True
    left = np.flatnonzero(~gone_pair[pair])
    picks, rounds = [left[:0]], [left[:0]]
    while left.size:
        start = np.flatnonzero(np.diff(row[left], prepend=-1))
        left = left[np.repeat(np.logical_or.reduceat(can[left], start), np.diff(start, append=left.size))]
        start = np.flatnonzero(np.diff(row[left], prepend=-1))
        head, many = left[start], np.diff(start, append=left.size) > 1
        gap = score[head]
        gap[many] -= score[left[start[many] + 1]]
        ok = can[head] & ~(_nine(gap) < least[head])
        falling = -_nine(score[head] + gap * 0.45 + bonus[head])[ok]
        falling[np.isnan(falling)] = -np.inf  # no number comes first, as in Spark
        head = head[ok]
        order = np.lexsort((falling, group[head]))
        pick = np.bincount(pair[left], minlength=len(pair))[pair[head]] == 1
        pick[order[np.flatnonzero(np.diff(group[head][order], prepend=-1))]] = True
        head = head[pick]
        picks.append(head)
        rounds.append(np.full(len(head), len(rounds)))
        gone_pair[pair[head]] = gone_row[row[head]] = True
        going = np.zeros(len(group), bool)
        going[group[head]] = True
        left = left[going[group[left]] & ~gone_row[row[left]] & ~gone_pair[pair[left]]]
    found = rows.select(["group", "row", "uid", "score"]).take(pa.array(np.concatenate(picks)))
    return found.append_column("round", pa.array(np.concatenate(rounds), pa.int32()))


def _in_jobs(rows: DataFrame) -> DataFrame:
    """Assignments of groups of any size; each round is a job, which writes what is left."""
    spark = rows.sparkSession
    used = rows.filter("score is null").select(F.col("group").alias("_g"), F.col("uid").alias("_u"))
    free = rows.filter("score is not null").join(used, F.col("group").eqNullSafe(F.col("_g")) & (F.col("uid") == F.col("_u")), "left_anti")
    folder = work_folder(spark, "assign")
    done: list[DataFrame] = []
    while True:
        alive = Window.partitionBy("group", "row")
        free = free.withColumn("_alive", F.max(F.col("least").isNotNull()).over(alive)).filter("_alive").drop("_alive")
        path = f"{folder}/open-{len(done)}"
        free.write.parquet(path)
        free = spark.read.schema(free.schema).parquet(path)
        if free.isEmpty():
            break
        best = Window.partitionBy("group", "row").orderBy(F.col("score").desc(), "uid")
        ranked = free.withColumns({"_n": F.row_number().over(best), "_next": F.coalesce(F.lead("score").over(best), F.lit(0.0)), "_rivals": F.count("*").over(Window.partitionBy("group", "uid"))})
        gap = F.col("score") - F.col("_next")
        heads = ranked.filter("_n = 1").withColumns({"gap": F.round(gap, 9), "quality": F.round(F.col("score") + gap * 0.45 + F.col("bonus"), 9)}).filter("gap >= least")
        first = F.row_number().over(Window.partitionBy("group").orderBy(F.col("quality").desc(), "row"))
        picks = heads.withColumn("_first", first).filter("_first = 1 or _rivals = 1").select("group", "row", "uid", "score", F.lit(len(done) + 1).alias("round"))
        path = f"{folder}/picks-{len(done)}"
        picks.write.parquet(path)
        picks = spark.read.schema(picks.schema).parquet(path)
        if picks.isEmpty():
            break
        done.append(picks)
        gone = picks.select(F.col("group").alias("_g"), F.col("row").alias("_r"), F.col("uid").alias("_u"))
        free = free.join(gone, F.col("group").eqNullSafe(F.col("_g")) & (F.col("row") == F.col("_r")), "left_anti")
        free = free.join(gone, F.col("group").eqNullSafe(F.col("_g")) & (F.col("uid") == F.col("_u")), "left_anti")
    if not done:
        return rows.select("group", "row", "uid", "score", F.lit(0).alias("round")).limit(0)
    return spark.read.schema(done[0].schema).parquet(*[f"{folder}/picks-{k}" for k in range(len(done))])
