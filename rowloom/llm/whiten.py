"""Whitening of embeddings by a bit-sliced scatter matrix.

Vectors become integers. Per batch every dimension is shifted to start at zero and cut into bit
planes, and each plane is packed across rows into 64-bit words. The cross-product of two
dimensions is the sum over their planes of 2^(a + b) times the bits that both words hold, so AND
and popcount give it exactly; the shift is taken back in integers. Tasks emit exact partial sums
in 32-bit limbs that Spark adds up, the sums are centred as integers, and only the finished
covariance, one number for each pair of dimensions, reaches the driver for its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import staged

#: 32-bit limbs that hold a partial sum, the last one signed: sums of up to 2^63 products of 63-bit numbers.
LIMBS = 6
BLOCK = 8192


def grid(vector: Column, scale: int = 256) -> Column:
    """floor(scale * c) of every entry as long; null for a vector that is null, empty or holds null or non-finite entries.

    Entries beyond the range of a long stand at its end.
    """
    wide = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(wide, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when((F.size(vector) > 0) & ~bad, F.transform(wide, lambda c: F.floor(c * scale)))


def bit_planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shift of each dimension, and planes[a][i], bit a of dimension i packed over the rows of ``x``."""
    low = x.min(axis=0)
    moved = x.view(np.uint64) - low.view(np.uint64)  # wraps to the true difference
    n_planes = int(moved.max()).bit_length()
    width = -(-len(x) // 64) * 8
    planes = np.zeros((n_planes, x.shape[1], width), np.uint8)
    for a in range(n_planes):
        bits = ((moved >> np.uint64(a)) & np.uint64(1)).astype(np.uint8)
        packed = np.packbits(bits, axis=0).T
        planes[a, :, : packed.shape[1]] = packed
    return low, planes.view(np.uint64)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products of the columns of ``x`` as Python integers."""
    low, planes = bit_planes(x)
    n_planes, d, words = planes.shape
    shared = np.zeros((d, d), object)
    sums = np.zeros(d, object)
    step = max(1, 500_000 // (d * words))  # dimensions at once, so that what is ANDed stays in the cache
    for a in range(n_planes):
        sums += np.bitwise_count(planes[a]).sum(axis=1, dtype=np.int64).astype(object) << a
        for b in range(a, n_planes):
            both = np.empty((d, d), np.int64)
            for i in range(0, d, step):
                both[i : i + step] = np.bitwise_count(planes[a][i : i + step, None] & planes[b][None]).sum(axis=2, dtype=np.int64)
            both = both if a == b else both + both.T
            shared += both.astype(object) << (a + b)
    shift = low.astype(object)
    total = sums + shift * len(x)
    return total, shared + np.outer(shift, sums) + np.outer(sums, shift) + np.outer(shift, shift) * len(x)


def _limbs(values: np.ndarray) -> list[np.ndarray]:
    parts = [((values >> (32 * k)) & 0xFFFFFFFF).astype(np.int64) for k in range(LIMBS - 1)]
    return [*parts, (values >> (32 * (LIMBS - 1))).astype(np.int64)]


def sums_of(vectors: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sums and cross-products of the rows of ``x``, arrays of ``d`` longs, exactly."""
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, cross = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            for s in range(0, len(x), BLOCK):
                part = np.ascontiguousarray(x[s : s + BLOCK])
                t, c = scatter(part)
                n, total, cross = n + len(part), total + t, cross + c
        if n:
            cells = np.concatenate([np.array([n], object), total, cross[upper]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), *map(pa.array, _limbs(cells))], ["cell", *(f"l{k}" for k in range(LIMBS))])

    schema = "cell long, " + ", ".join(f"l{k} long" for k in range(LIMBS))
    cells = vectors.select("x").mapInArrow(run, schema).groupBy("cell").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)])
    found = np.zeros(1 + d + len(upper[0]), object)
    for r in cells.toLocalIterator():  # one row for each pair of dimensions
        found[r["cell"]] = sum(r[f"l{k}"] << (32 * k) for k in range(LIMBS))
    cross = np.zeros((d, d), object)
    cross[upper] = found[1 + d :]
    cross.T[upper] = found[1 + d :]
    return int(found[0]), found[1 : 1 + d], cross


class Whitening:
    """Mean, components and eigenvalues of vectors of ``d`` longs.

    Components are unit eigenvectors by falling eigenvalue, the largest entry of each positive.
    An eigenvalue within rounding of zero counts as zero.
    """

    def __init__(self, n: int, sums: np.ndarray, cross: np.ndarray, top: int) -> None:
        self.n, self.sums, self.d = n, sums, len(sums)
        centred = cross * n - np.outer(sums, sums)  # n squared times the covariance, exact
        square = n * n
        self.covariance = np.array([[c / square for c in row] for row in centred.tolist()], np.float64).reshape(self.d, self.d)
        values, vectors = np.linalg.eigh(self.covariance)
        self.top = min(top, self.d)
        values, vectors = values[::-1][: self.top], vectors[:, ::-1][:, : self.top]
        self.values = np.where(values > self.d * np.finfo(float).eps * max(values.max(initial=0.0), 0.0), values, 0.0)
        lead = np.abs(vectors).argmax(axis=0)
        self.components = vectors * np.where(vectors[lead, np.arange(self.top)] < 0, -1.0, 1.0)
        trace = sum(centred[i, i] for i in range(self.d)) / square
        self.explained = self.values / trace if trace else np.full(self.top, np.nan)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: longs where they fit, else Python integers."""
        most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
        fits = 2 * (most * self.n + max(map(abs, self.sums.tolist()))) < 2**62
        return x * self.n - self.sums.astype(np.int64) if fits else x.astype(object) * self.n - self.sums

    def apply(self, x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """For each row of ``x`` the sum of its squared deviations (null beyond a long), and its whitened components (NaN for a zero eigenvalue)."""
        off = self.deviations(x)
        most = int(np.abs(off).max(initial=0))
        squares = (off * off if most * most * self.d < 2**63 else off.astype(object) ** 2).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            white = (off.astype(np.float64) / self.n) @ self.components / np.where(self.values > 0, np.sqrt(self.values), np.nan)
        return [s if s < 2**63 else None for s in squares.tolist()], white


def fit(distinct: DataFrame, d: int, top: int = 4) -> Whitening:
    """The whitening of the rows of ``distinct`` (x: array of ``d`` longs), each counted once."""
    return Whitening(*sums_of(distinct, d), top)


def identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened rows of ``distinct`` minus the identity; null where no eigenvalue is above zero."""
    live = np.flatnonzero(model.values > 0)
    k = len(live)
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cross = np.zeros(k), np.zeros((k, k))  # whitened rows are centred, so these are about their mean up to rounding
        for batch in batches:
            for s in range(0, len(batch), BLOCK):
                white = model.apply(batch.column("x").slice(s, BLOCK).flatten().to_numpy().reshape(-1, model.d))[1][:, live]
                total, cross = total + white.sum(axis=0), cross + white.T @ white
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k)), pa.array(np.concatenate([total, cross.ravel()]))], ["cell", "v"])

    cells = np.zeros(k + k * k)
    for r in distinct.select("x").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():  # one row for each pair of components
        cells[r["cell"]] = r["v"] / model.n
    mean = cells[:k]
    return float(np.abs(cells[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", top: int = 4) -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Fitted on every distinct vector of integers once, applied to all rows, repeated ones too;
    other columns are ignored. Rows whose vector is null, empty or holds null or non-finite entries go,
    and so do vectors of another than the most frequent length (of equals the longer).
    ``deviation`` is null beyond a long; ``whitened`` is null for an eigenvalue of zero, and the
    shares are null where nothing varies. An empty table gives no rows.
    """
    spark = rows.sparkSession
    held = rows.select(F.col(vec_id).alias("vec_id"), grid(F.col(vector)).alias("x")).filter("x is not null")
    schema = f"vec_id {held.schema['vec_id'].dataType.simpleString()}, {RESULT}"
    distinct = staged(held.select("x").distinct(), "distinct-vectors")
    sizes = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    d = sizes["d"]
    distinct = distinct.filter(F.size("x") == d)
    model = fit(distinct, d, top)
    error = identity_error(distinct, model)
    shares = [None if np.isnan(v) else float(v) for v in model.explained]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.top
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            deviation, white = model.apply(x)
            take = pa.array(np.repeat(np.arange(len(x)), k))
            flat = white.ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(take),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(flat), model.n, np.int64)),
                    pa.array(deviation, pa.int64()).take(take),
                    pa.array(flat, mask=np.isnan(flat)),
                    pa.array(shares * len(x), pa.float64()),
                    pa.array([error] * len(flat), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return held.filter(F.size("x") == d).mapInArrow(run, schema)
