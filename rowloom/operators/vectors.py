"""The best rows of each query by inner product: blocks of both sides meet in tasks and are scored there as matrices."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Decimals of a score.
DIGITS = 6


def rounded(x: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """So many decimals, halves away from zero, as Spark's round(); values near a half go by their decimal form."""
    with np.errstate(all="ignore"):
        up = np.abs(x) * 10**digits
        whole = np.floor(up)
        part = up - whole
        near = ~(np.abs(part - 0.5) > 1e-3) | (up > 2**40)  # true for what isn't a number
        out = np.copysign((whole + (part >= 0.5)) / 10**digits, x) + 0.0
    for i in np.flatnonzero(near & np.isfinite(x)):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0
    return np.where(np.isfinite(x), out, x)


def in_sequence(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows ``i`` of ``a`` with rows ``j`` of ``b``, summed entry by entry as numbers.dot() does."""
    total = np.zeros(len(i))
    for x, y in zip(a.T, b.T, strict=True):
        total += x[i] * y[j]
    return total


class _Vectors:
    """A column of lists: the rows of each length as a matrix; rows that are null or hold a null have none."""

    def __init__(self, column: pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        offsets, values = column.offsets.to_numpy(), column.values
        sizes = np.diff(offsets)
        whole = column.is_valid().to_numpy(zero_copy_only=False).copy()
        if values.null_count:
            holes = np.append(0, np.cumsum(values.is_null().to_numpy(zero_copy_only=False)))
            whole &= holes[offsets[1:]] == holes[offsets[:-1]]
        flat = values.to_numpy(zero_copy_only=False)
        self.length = np.where(whole, sizes, -1)
        self.of = {}
        for n in np.unique(self.length[whole]).tolist():
            rows = np.flatnonzero(self.length == n)
            self.of[n] = rows, flat[offsets[rows][:, None] + np.arange(n)].reshape(len(rows), n)


def _codes(*columns: np.ndarray) -> np.ndarray:
    """Equal numbers for rows that are equal in every column."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        out = np.unique(out * (1 << 32) + np.unique(c, return_inverse=True)[1].ravel(), return_inverse=True)[1].ravel()
    return out


def _foremost(vectors: np.ndarray, label: np.ndarray, uid: np.ndarray, most: int) -> np.ndarray:
    """Rows without those copies of a vector and label that stand behind ``most`` others by id: in order."""
    raw = np.ascontiguousarray(vectors + 0.0)
    same = raw.view(np.dtype((np.void, max(1, raw.shape[1] * 8)))).ravel() if raw.shape[1] else np.zeros(len(raw), np.int8)
    code = _codes(same, label)
    order = np.lexsort((uid, code))
    code, ids = code[order], uid[order]
    first = np.append(True, code[1:] != code[:-1])
    fresh = first | np.append(True, ids[1:] != ids[:-1])
    count = np.cumsum(fresh)
    start = np.maximum.accumulate(np.where(first, count, 0))
    return np.sort(order[count - start < most])


def _groups(column: pa.ChunkedArray | None, n: int) -> np.ndarray:
    return np.zeros(n, np.int64) if column is None else column.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()


def _candidates(q: np.ndarray, r: np.ndarray, allowed: Callable[[slice], np.ndarray] | None, top: int, own: Callable[[slice], tuple], chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may be among the ``top`` of a row of ``q`` by rounded score: those that stand behind by no more than rounding and the order of summing can hide."""
    with np.errstate(all="ignore"):
        largest = np.abs(q).max(initial=0.0) * np.abs(r).max(initial=0.0) * max(1, q.shape[1])
    slack = 1.5 * 10**-DIGITS + 1e-12 * (largest if np.isfinite(largest) else 0.0)
    odd, strange = np.flatnonzero(~(np.abs(r) < 1e150).all(axis=1)), ~(np.abs(q) < 1e150).all(axis=1)
    found_i, found_j = [], []
    width = 32
    whole = len(r) // width * width
    for s in range(0, len(q), chunk):
        part = slice(s, min(len(q), s + chunk))
        with np.errstate(all="ignore"):
            near = q[part] @ r.T
        near[:, odd] = -np.inf
        near[strange[part]] = 0.0
        keep = None if allowed is None else allowed(part)
        if keep is not None:
            near[~keep] = -np.inf
        oi, oj = own(part)
        near[oi, oj] = -np.inf
        # the top-th largest of the maxima of short runs is no larger than the top-th largest
        runs = near[:, :whole].reshape(len(near), -1, width).max(axis=2)
        runs = np.hstack([runs, near[:, whole:]])
        least = np.partition(runs, -top, axis=1)[:, -top] if runs.shape[1] >= top else np.full(len(near), -np.inf)
        least[strange[part]] = -np.inf
        i, j = np.nonzero((near >= (least - slack)[:, None]) & (near > -np.inf))
        found_i.append(i + s), found_j.append(j)
        if len(odd):
            into = np.zeros(near.shape, bool)
            into[:, odd] = True if keep is None else keep[:, odd]
            into[oi, oj] = False
            i, j = np.nonzero(into)
            found_i.append(i + s), found_j.append(j)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(found_i or none), np.concatenate(found_j or none)


def _meeting(query: str, row: str, pair: tuple[str, str], gate: tuple[str, str] | None, own: float | None, top: int, more: dict[str, tuple[str, str]], left: list[str], right: list[str], schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The function of one task: the ``top`` rows of a block for each query of a block."""

    def met(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        mine, ids = asked.column(query).to_numpy(), held.column(row).to_numpy()
        by_id = np.argsort(ids, kind="stable")
        in_order = ids[by_id]
        wanted = _groups(asked.column(gate[0]) if gate else None, len(mine))
        label = _groups(held.column(gate[1]) if gate else None, len(ids))
        open_to_all = asked.column(gate[0]).is_null().to_numpy() if gate else np.ones(len(mine), bool)
        q, r = _Vectors(asked.column(pair[0])), _Vectors(held.column(pair[1]))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def fits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return open_to_all[i] | ((wanted[i] == label[j]) & (label[j] != np.iinfo(np.int64).min))

        if own is not None:
            low, high = np.searchsorted(in_order, mine, "left"), np.searchsorted(in_order, mine, "right")
            i = np.repeat(np.arange(len(mine)), high - low)
            j = by_id[np.repeat(low - np.append(0, np.cumsum(high - low)[:-1]), high - low) + np.arange(len(i))]
            ok = fits(i, j)
            out.append((i[ok], j[ok], np.full(ok.sum(), own), np.zeros(ok.sum(), bool)))
        for n, (qi, qv) in q.of.items():
            if n not in r.of:
                continue
            ri, rv = r.of[n]
            some = _foremost(rv, label[ri], ids[ri], top + 1)
            ri, rv = ri[some], rv[some]
            at = np.argsort(ids[ri], kind="stable")
            ordered = ids[ri][at]

            def own_pairs(part: slice, qi=qi, at=at, ordered=ordered) -> tuple[np.ndarray, np.ndarray]:
                asks = mine[qi[part]]
                low, high = np.searchsorted(ordered, asks, "left"), np.searchsorted(ordered, asks, "right")
                if own is None:
                    high = low
                i = np.repeat(np.arange(len(asks)), high - low)
                return i, at[np.repeat(low - np.append(0, np.cumsum(high - low)[:-1]), high - low) + np.arange(len(i))]

            allowed = (lambda part, qi=qi, ri=ri: fits(qi[part][:, None], ri[None, :])) if gate else None
            i, j = _candidates(qv, rv, allowed, top, own_pairs)
            out.append((qi[i], ri[j], rounded(in_sequence(qv, rv, i, j)), np.zeros(len(i), bool)))
        i, j, score, unscored = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
        # pairs without a score come after all others, by id: as many of them as places are left
        short = np.flatnonzero(np.bincount(i, minlength=len(mine)) < top)
        for k in short.tolist():
            if q.length[k] >= 0 and (r.length == q.length[k]).all():
                continue
            rest = by_id[((q.length[k] < 0) | (r.length[by_id] != q.length[k])) & fits(np.array([k]), by_id) & ((own is None) | (in_order != mine[k]))][:top]
            i, j, score, unscored = np.append(i, np.full(len(rest), k)), np.append(j, rest), np.append(score, np.zeros(len(rest))), np.append(unscored, np.ones(len(rest), bool))
        down = np.where(np.isnan(score), -np.inf, -score)
        order = np.lexsort((ids[j], down, ~np.isnan(score), unscored, i))
        i, j, score, unscored = i[order], j[order], score[order], unscored[order]
        first = np.append(True, i[1:] != i[:-1]) if len(i) else np.zeros(0, bool)
        place = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0)) if len(i) else i
        kept = place < top
        i, j, score, unscored = i[kept], j[kept], score[kept], unscored[kept]
        columns = [asked.column(c).take(pa.array(i)) for c in left] + [held.column(c).take(pa.array(j)) for c in right]
        columns.append(pa.array(score, pa.float64(), mask=unscored))
        for a, b in more.values():
            qa, rb = _Vectors(asked.column(a)), _Vectors(held.column(b))
            value, there = np.zeros(len(i)), np.zeros(len(i), bool)
            for n, (qi, qv) in qa.of.items():
                if n not in rb.of:
                    continue
                ri, rv = rb.of[n]
                k = np.flatnonzero((qa.length[i] == n) & (rb.length[j] == n))
                value[k], there[k] = rounded(in_sequence(qv, rv, np.searchsorted(qi, i[k]), np.searchsorted(ri, j[k]))), True
            columns.append(pa.array(value, pa.float64(), mask=~there))
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return met


def best_by_product(queries: DataFrame, rows: DataFrame, pair: tuple[str, str], top: int = 5, query: str = "query_id", row: str = "uid", gate: tuple[str, str] | None = None, own: float | None = None, more: dict[str, tuple[str, str]] | None = None, query_block: int = 32_000, row_block: int = 32_000, least_blocks: int = 24) -> DataFrame:
    """The ``top`` rows of each query by ``score``, best first, with their ``place``; ties go to the smaller id.

    queries and rows: a long id each and the vectors named by ``pair``. score: their inner product to six
    decimals, null, and last, where they differ in length or hold a null. gate: columns of the query and of the row that have to be equal, unless the query's is null.
    own: what a query scores with the row of its own id, which else counts like any other. more: other products
    of the pairs that are kept. All other columns of both sides are passed on; the vectors aren't.

    Both sides are cut into blocks of a counted size by hash, and every block of queries meets every
    block of rows in one task, as the method asks every pair. A task scores its pairs as a product of matrices, sums those that
    may be among the best anew in the order of the entries, and passes on ``top`` rows of a query; these partial tops are merged.
    What is shuffled is each side once for every block of the other, and no pair is ever sorted or shuffled that isn't kept by a task.
    """
    more = more or {}
    n_asked, n_held = queries.count(), rows.count()
    asked = max(1, -(-n_asked // query_block))
    held = max(1, -(-n_held // row_block), min(-(-n_held // 1_000), -(-least_blocks // asked)))
    vectors = {*pair, *(c for both in more.values() for c in both)}
    left, right = ([f for f in side.schema.fields if f.name not in vectors] for side in (queries, rows))
    number = [T.StructField(c, T.DoubleType()) for c in ("score", *more)]
    schema = T.StructType([*left, *right, *number])
    cell = (F.col("_q") * held + F.col("_r")).cast("int").alias("_cell")
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("_q", block(query, asked)).withColumn("_r", every(held)).select(cell, *queries.columns)
    r = rows.withColumn("_r", block(row, held)).withColumn("_q", every(asked)).select(cell, *rows.columns)
    tasks = 3 * asked * held  # blocks fall into tasks by hash; more tasks than blocks keep most apart
    met = _meeting(query, row, pair, gate, own, top, more, [f.name for f in left], [f.name for f in right], to_arrow_schema(schema))
    found = q.repartition(tasks, "_cell").groupBy("_cell").cogroup(r.repartition(tasks, "_cell").groupBy("_cell")).applyInArrow(met, schema)
    order = Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(row))
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
