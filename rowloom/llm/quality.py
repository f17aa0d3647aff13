"""Quality by ordinal cumulative-link regression on graded ratings.

Grades are ordered; the model has one set of weights and one threshold between each two
neighbouring grades: P(grade > k) = logistic(w.x - t_k). Features are the frequencies of
hashed byte 4-grams and a few measures of shape. The expected grade ranks documents, and the
tail probability of reaching a grade selects them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import staged

SIZE = 1024  # hash classes of the 4-grams, a power of two
SHAPES = ("log size", "white space", "line ends", "ASCII letters", "digits", "other ASCII", "beyond ASCII", "same as before", "word starts that repeat")


def _classes() -> np.ndarray:
    """Shape class of each byte."""
    kind = np.full(256, 4, np.uint8)
    kind[[9, 11, 12, 13, 32]], kind[10] = 0, 1
    kind[48:58], kind[65:91], kind[97:123], kind[128:] = 3, 2, 2, 5
    return kind


CLASS = _classes()


def grams(data: np.ndarray) -> np.ndarray:
    """Hash class of the 4-gram that begins at each byte; the last three bytes have none."""
    d = data.astype(np.uint32)
    whole = d[:-3] | (d[1:-2] << 8) | (d[2:-1] << 16) | (d[3:] << 24)
    return (whole * np.uint32(2654435761)) >> np.uint32(33 - SIZE.bit_length())


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-gram classes of all texts in one array, each text's begin and end in it, and the rows of shapes.

    A text's last three bytes begin no 4-gram; a text of under five bytes is filled up with zero bytes to five.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    filled = [r if len(r) > 4 else r.ljust(5, b"\0") for r in raw]
    data = np.frombuffer(b"".join(filled), np.uint8)
    ends = np.cumsum([len(r) for r in filled])
    starts = ends - [len(r) for r in filled]
    n = (ends - starts).astype(float)
    kind = CLASS[data]
    shares = [np.add.reduceat((kind == k).astype(np.int32), starts) / n for k in range(6)]
    same = np.concatenate([[0], (data[1:] == data[:-1])]).astype(np.int32)
    same[starts] = 0
    code = grams(np.concatenate([data, np.zeros(3, np.uint8)]))
    # starts of words; those whose 4-gram has stood in the text before repeat
    opens = np.concatenate([[True], kind[:-1] < 2])
    opens[starts] = True
    head = np.flatnonzero(opens & (kind >= 2))
    row = np.searchsorted(ends, head, side="right")
    head, row = head[head < ends[row] - 3], row[head < ends[row] - 3]
    distinct = np.bincount(np.unique(row.astype(np.int64) * SIZE + code[head]) // SIZE, minlength=len(raw))
    words = np.bincount(row, minlength=len(raw))
    repeats = 1 - distinct / np.maximum(words, 1)
    shape = np.stack([np.log1p([len(r) for r in raw]) / 10, *shares, np.add.reduceat(same, starts) / n, repeats * (words > 0)], axis=1)
    return code, np.stack([starts, ends - 3], axis=1), shape


def means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean of values[begin:end] for each row of bounds (never empty)."""
    flat = np.add.reduceat(np.append(values, 0), bounds.ravel())[::2]
    return flat / (bounds[:, 1] - bounds[:, 0])


class OrdinalModel:
    """Weights of 4-gram classes (for frequencies times their scale), of shapes, and ordered thresholds."""

    def __init__(self, gram: np.ndarray, shape: np.ndarray, mean: np.ndarray, spread: np.ndarray, thresholds: np.ndarray):
        self.gram, self.shape, self.mean, self.spread, self.thresholds = gram, shape, mean, spread, thresholds

    def margin(self, texts: list[str | None]) -> np.ndarray:
        code, bounds, shape = features(texts)
        z = np.clip((shape - self.mean) / self.spread, -6, 6)
        return means(self.gram[code], bounds) + z @ self.shape

    def tails(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text and k."""
        return 1 / (1 + np.exp(-np.clip(margin[:, None] - self.thresholds, -300, 300)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, n_grades: int, penalty: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the penalised likelihood, by Newton steps with halving.

    The likelihood of a grade is the difference of neighbouring tails; thresholds are a first
    one and logarithms of gaps, so they stay in order.
    """
    k = n_grades - 1
    share = np.array([(grade > j).mean() for j in range(k)]).clip(1e-3, 1 - 1e-3)
    start = np.sort(-np.log(share / (1 - share)))
    free = np.concatenate([[start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    w = np.zeros(x.shape[1])

    def split(free):
        return np.cumsum(np.concatenate([[free[0]], np.exp(free[1:])]))

    def loss_parts(w, free):
        t = np.concatenate([[-np.inf], split(free), [np.inf]])
        s = x @ w
        up, low = 1 / (1 + np.exp(-np.clip(s - t[grade], -50, 50))), 1 / (1 + np.exp(-np.clip(s - t[grade + 1], -50, 50)))
        up, low = np.where(grade == 0, 1.0, up), np.where(grade == k, 0.0, low)
        return up, low, np.maximum(up - low, 1e-12)

    def loss(w, free):
        return -np.log(loss_parts(w, free)[2]).sum() + 0.5 * (penalty * w) @ w + 0.01 * free[1:] @ free[1:]

    now = loss(w, free)
    for _ in range(rounds):
        up, low, p = loss_parts(w, free)
        du, dl = up * (1 - up), low * (1 - low)
        slope = (du - dl) / p
        g_t = np.zeros((len(grade), k))  # of the log likelihood by each threshold
        rows = np.arange(len(grade))
        has_up, has_low = grade > 0, grade < k
        g_t[rows[has_up], grade[has_up] - 1] = -(du / p)[has_up]
        g_t[rows[has_low], grade[has_low]] = (dl / p)[has_low]
        jac = np.zeros((k, k))  # thresholds by free parameters
        jac[:, 0] = 1
        for j in range(1, k):
            jac[j:, j] = np.exp(free[j])
        g_free = g_t @ jac
        full = np.hstack([x * slope[:, None], g_free])
        grad = full.sum(axis=0) - np.concatenate([penalty * w, [0], 0.02 * free[1:]])
        # expected curvature is close to the sum of squared slopes plus what the logistic adds
        weight = np.sqrt(np.maximum(du + dl, 1e-6))
        curve = np.hstack([x * weight[:, None], -(weight[:, None] / np.maximum(1, has_up + has_low.astype(int))[:, None]) * np.sign(np.abs(g_t)) @ jac])
        hess = curve.T @ curve + np.diag(np.concatenate([penalty, np.full(k, 0.02)]))
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-4:
            w2, f2 = w + size * step[: len(w)], free + size * step[len(w) :]
            if np.isfinite(new := loss(w2, f2)) and new < now:
                break
            size /= 2
        else:
            break
        done = now - new < 1e-6 * abs(now)
        w, free, now = w2, f2, new
        if done:
            break
    return w, split(free)


def grades_of(labels: DataFrame) -> DataFrame:
    """Graded ratings from the label table: 0 poor, 1 good but toxic, 2 good; by doc_id, the lowest of contradicting ones."""
    grade = F.when(F.col("quality") == 0, 0).otherwise(F.when(F.col("toxic") == 1, 1).otherwise(2))
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg(F.min(grade).cast("int").alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, max_docs: int = 6_000, per_gram: float = 30.0) -> OrdinalModel | None:
    """Train on the ``max_docs`` rated documents with the smallest hash of their doc_id; None without any.

    The sample, a row of ``SIZE`` frequencies and the shapes for each document, is collected, so ``max_docs`` bounds what the driver holds.
    """
    known = ratings.select(F.col("doc_id").alias("_id"), "grade").orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("text", "grade")
    sample = staged(sample, "rated-sample").repartition(8)

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 100):
                part = batch.slice(s, 100)
                code, bounds, shape = features(part.column("text").to_pylist())
                gram = np.stack([np.bincount(code[a:b], minlength=SIZE) / (b - a) for a, b in bounds])
                rows = [r.tobytes() for r in np.hstack([shape, gram]).astype(np.float32)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), part.column("grade")], ["x", "grade"])

    sample = sample.filter(F.col("grade").between(0, n_grades - 1))
    rows = sorted((r["grade"], bytes(r["x"])) for r in sample.mapInArrow(table, "x binary, grade int").collect())
    if not rows:
        return None
    grade = np.array([g for g, _ in rows])
    values = np.stack([np.frombuffer(x, np.float32) for _, x in rows]).astype(float)
    shape, gram = values[:, : len(SHAPES)], values[:, len(SHAPES) :]
    mean, spread = shape.mean(axis=0), shape.std(axis=0) + 1e-6
    gram_mean, scale = gram.mean(axis=0), 1 / (gram.std(axis=0) + 1e-4)
    x = np.hstack([np.clip((shape - mean) / spread, -6, 6), (gram - gram_mean) * scale])
    penalty = np.concatenate([np.full(shape.shape[1], 0.1), np.full(SIZE, per_gram)])
    w, thresholds = fit_ordinal(x, grade, n_grades, penalty)
    weights = (w[shape.shape[1] :] * scale).astype(np.float32)
    thresholds = thresholds + (gram_mean * weights).sum()
    return OrdinalModel(weights, w[: shape.shape[1]], mean, spread, thresholds)


def score(docs: DataFrame, model: OrdinalModel | None, n_grades: int = 3, at_least: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ``expected_grade``, ``tail_prob`` (of grade ``at_least`` or more) and ``keep`` (where that is 0.5 or more) of every row.

    A null text counts as an empty one; other columns are ignored; without a model the
    probability is 1 and the grade the highest, so that nothing is dropped unjudged.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(float(n_grades - 1)).alias("expected_grade"), F.lit(1.0).alias("tail_prob"), F.lit(True).alias("keep"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 300):
                part = batch.slice(s, 300)
                tails = model.tails(model.margin(part.column("text").to_pylist()))
                tail = tails[:, at_least - 1]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= 0.5)], ["doc_id", "expected_grade", "tail_prob", "keep"])

    return rows.mapInArrow(judged, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, expected_grade double, tail_prob double, keep boolean")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the ratings that aren't held out and score every row."""
    return score(docs, fit(docs, grades_of(labels.filter(~held_out(F.col("doc_id"))))))
