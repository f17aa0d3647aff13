"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel compares words by the letter triples that they hold in order, gaps allowed: a triple
that spans more letters weighs less, so a word with an inserted letter keeps most of its
triples. Landmarks are words of the training sample; a machine is trained on the Nyström
features of the sample's words, weighted by how often documents of either label hold them, and
of virtual examples, telling words with one or two letters put in. As the features are linear
in the triples, the trained machine folds into one weight per triple, and a word is scored by
looking its triples up. A document's worst word, and all its bad words together, make its
probability, by a logistic fit on the training documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.common import staged

SPAN = 5  # a triple's second and third letter lie within so many letters of its first
DECAY = 0.7  # weight of each letter that a triple spans
CEILING = 3.0  # scores beyond count no more
LEVELS = (0.0, 0.75, 1.5)  # of word scores, for a document's features
WIDTH = 32  # longer words are cut into overlapping parts of this length
_STEPS = [(i, j) for i in range(1, SPAN) for j in range(i + 1, SPAN + 1)]
_SPLIT = re.compile(r"[\W_]+")
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[\W_]+[^\W_](?![^\W_])){2,}")
#: Signs that stand for letters, fixed values.
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_SIGN_TABLE = str.maketrans(_SIGNS)
_HIDDEN = "*_-'~^"
_EDGE = "!.,;:?()[]{}\"|#%&+=/<>*_-'~^"


def parts_of(token: str) -> list[str]:
    """The words in a token without white space: lower case, marks inside dropped, letter signs read as letters."""
    core = token.lower().strip(_EDGE)
    if core.isalpha():
        return [core] if len(core) > 1 else []
    for mark in _HIDDEN:
        if mark in core:
            core = core.replace(mark, "")
    if any(c in _SIGNS for c in core) and any(c.isalpha() for c in core):
        core = core.translate(_SIGN_TABLE)
    pieces = _SPLIT.split(core)
    if len(pieces) > 2 and all(len(p) == 1 for p in pieces):
        return ["".join(pieces)]
    return [p for p in pieces if len(p) > 1]


def tokens_of(text: str | None) -> set[str]:
    """Distinct tokens of the whole text; letters that stand alone in a row also make one token."""
    if not text:
        return set()
    found = set(text.split())
    short = [t for t in found if len(t) < 3]
    if len({c for t in short for c in t if c.isalnum()}) > 2 and sum(1 for t in short if len(t.strip(_EDGE)) == 1) > 2:
        found.update("".join(c for c in m[0] if c.isalnum()) for m in _SPACED.finditer(text))
    return found


def letter_codes(words: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """A row of letter codes, 0 at the end, for each part of each word, and the word's number."""
    owner, parts = [], []
    for i, w in enumerate(words):
        w = f"^{w}$"
        for s in range(0, max(1, len(w) - 8), WIDTH - 8):
            parts.append(w[s : s + width])
            owner.append(i)
    points = np.array(parts, dtype=f"U{width}").view(np.int32).reshape(len(parts), width)
    codes = 27 + points % 35
    np.subtract(points, 96, out=codes, where=(points >= 97) & (points <= 122))
    codes[points == 94], codes[points == 36], codes[points == 0] = 62, 63, 0
    return codes, np.array(owner)


def triples(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """Words' numbers, triples and which are real, for each gap pattern; its weight."""
    codes, owner = letter_codes(words)
    for i, j in _STEPS:
        a, b, c = codes[:, : WIDTH - j], codes[:, i : WIDTH - j + i], codes[:, j:]
        yield owner, (a << 12) | (b << 6) | c, c > 0, DECAY ** (j - 2)


def by_width(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Codes, owners and width of the words' parts, short words in narrow matrices."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for least, width in ((-1, 12), (10, 20), (18, WIDTH)):
        chosen = np.flatnonzero((lengths > least) & ((lengths <= width - 2) | (width == WIDTH)))
        if len(chosen):
            codes, owner = letter_codes([words[i] for i in chosen], width)
            yield codes, chosen[owner], width


def norm_of(codes: np.ndarray) -> np.ndarray:
    """Root of the sum of squared triple weights of each row."""
    real = np.count_nonzero(codes, axis=1)
    return np.sqrt(np.maximum(sum(np.maximum(real - j, 0) * DECAY ** (2 * j - 4) for _, j in _STEPS), 1e-9))


def word_scores(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Highest over a word's parts of the sum of the triples' weights over the part's norm.

    The last of ``weights`` is the machine's offset. Triples that reach past a word's end have
    weight 0, and a score lies between -1 and ``CEILING``.
    """
    best = np.full(len(words), -1.0)
    for codes, owner, width in by_width(words):
        total = np.zeros(len(codes))
        high, middle = codes << 12, codes << 6
        for i, j in _STEPS:
            ids = high[:, : width - j] | middle[:, i : width - j + i]
            ids |= codes[:, j:]
            total += weights[ids].sum(axis=1) * DECAY ** (j - 2)
        np.maximum.at(best, owner, total / norm_of(codes) + weights[-1])
    return np.minimum(best, CEILING)


def landmark_table(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The triples of the landmarks, in order, and a row of values for each: its weight in every landmark, over the norm of its last part."""
    found = [(ids[real], np.repeat(owner, ids.shape[1]).reshape(ids.shape)[real], weight) for owner, ids, real, weight in triples(landmarks)]
    known, at = np.unique(np.concatenate([ids for ids, _, _ in found]), return_inverse=True)
    values = np.zeros((len(known), len(landmarks)), np.float32)
    weights = np.concatenate([np.full(len(ids), weight, np.float32) for ids, _, weight in found])
    np.add.at(values, (at, np.concatenate([rows for _, rows, _ in found])), weights)
    for codes, owner, _ in by_width(landmarks):
        for row, norm in zip(owner, norm_of(codes), strict=True):
            values[:, row] /= norm
    return known, values


def kernel_blocks(words: list[str], known: np.ndarray, values: np.ndarray, block: int = 4000) -> Iterator[tuple[int, np.ndarray]]:
    """For each block of words its start and its kernel with each landmark (a word of several parts: the last one's)."""
    place = np.full(1 << 18, len(known), np.int32)
    place[known] = np.arange(len(known))
    for s in range(0, len(words), block):
        some = words[s : s + block]
        out = np.zeros((len(some), values.shape[1]), np.float32)
        for codes, owner, width in by_width(some):
            sums = np.zeros((len(codes), values.shape[1]), np.float32)
            for i, j in _STEPS:
                ids = place[(codes[:, : width - j] << 12) | (codes[:, i : width - j + i] << 6) | codes[:, j:]]
                for column in range(ids.shape[1]):
                    hit = np.flatnonzero(ids[:, column] < len(known))
                    sums[hit] += values[ids[hit, column]] * np.float32(DECAY ** (j - 2))
            out[owner] = sums / norm_of(codes)[:, None]
        yield s, out


def landmark_features(words: list[str], landmarks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kernel of each word with each landmark; the landmarks' triples and their values."""
    known, values = landmark_table(landmarks)
    return np.concatenate([k for _, k in kernel_blocks(words, known, values)]), known, values


def with_letters(word: str, count: int, how_many: int, letters: str) -> list[str]:
    """``how_many`` versions of the word with ``count`` random letters put in; the word seeds the draws."""
    rng = np.random.default_rng([count, *word.encode("utf-8", "surrogatepass")])
    out = []
    for _ in range(how_many):
        made = word
        for _ in range(count):
            at = int(rng.integers(1, max(2, len(made))))
            made = made[:at] + letters[rng.integers(len(letters))] + made[at:]
        out.append(made)
    return out


def _product(x: np.ndarray, w: np.ndarray, block: int = 4096) -> np.ndarray:
    """x @ w in doubles, a block of rows at a time: the whole of x as doubles would take twice its room."""
    return np.concatenate([x[s : s + block].astype(np.float64) @ w for s in range(0, len(x), block)])


def train_machine(words: list[str], pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, n_landmarks: int, hard: np.ndarray, penalty: float = 1e-5, versions: int = 30) -> np.ndarray:
    """One weight per triple, from the numbers ``pos`` and ``neg`` of toxic and other documents that hold each word.

    A toxic document says little about most of its words. A word is a witness as far as more
    toxic documents hold it than chance explains; after a first training, words that no other
    document holds and that the machine takes for witnesses' kin become witnesses too. Witnesses
    also stand as virtual examples, ``versions`` with one letter put in and as many with two, so
    that the machine weighs triples by what they say across a gap. Landmarks are the witnesses,
    then hard words, then common ones.
    """
    expected = neg * n_pos / n_neg
    z = (pos - expected) / np.sqrt(expected + 1)
    surprise = np.clip(1 - 9 / np.maximum(z, 1e-9) ** 2, 0, 1) * (z > 0)
    if not surprise.any():
        surprise = np.clip(z, 0, None)
    telling = np.lexsort((np.arange(len(z)), -z))[: n_landmarks // 2]
    common = np.lexsort((np.arange(len(z)), -neg, ~hard))[:n_landmarks]
    chosen = list(dict.fromkeys([*telling.tolist(), *common.tolist()]))[:n_landmarks]
    letters = "".join(sorted({c for i in np.argsort(-neg, kind="stable")[:2000] for c in words[i] if c.isalpha()})) or "e"
    witnesses = [int(i) for i in telling if z[i] >= 4]
    made = [(v, i) for i in witnesses for count in (1, 2) for v in with_letters(words[i], count, versions, letters)]
    known_words = set(words)
    made = [(v, i) for v, i in made if v not in known_words]
    of_word = np.array([i for _, i in made], np.int64)
    # the more documents speak for a word, the wider the margin that it is to keep
    odds = np.log(((pos + 0.5) / n_pos) / ((neg + 0.5) / n_neg))
    goal = np.clip(odds / 2 * pos / (pos + 10), 1, 4)
    goal = np.concatenate([goal, goal[of_word]])
    marks, known, values = landmark_features([words[i] for i in chosen], [words[i] for i in chosen])
    spread, vectors = np.linalg.eigh(marks.astype(np.float64))
    keep = spread > 1e-3 * spread.max()
    whiten = vectors[:, keep] / np.sqrt(spread[keep])
    x = np.ones((len(words) + len(made), whiten.shape[1] + 1), np.float32)
    for at, kernel in kernel_blocks([*words, *(v for v, _ in made)], known, values):
        x[at : at + len(kernel), :-1] = kernel @ whiten.astype(np.float32)
    push = (neg + 0.1) / (neg + 0.1).sum()
    push = push + (neg > 0) / max(1, (neg > 0).sum())  # rare words count too
    if hard.any():
        push = push + 2 * hard / hard.sum()
    push = np.concatenate([push, np.zeros(len(made))])
    for again in range(3):
        pull = pos / n_pos * surprise
        pull = pull / max(pull.sum(), 1e-12)
        pull = np.concatenate([pull, pull[of_word] / max(1, versions)])
        w = np.zeros(x.shape[1])
        for _ in range(20):  # Newton's method on the squared hinge
            s = _product(x, w)
            short, above = pull * (s < goal), push * (s > -1)
            curve, slope = penalty * np.eye(len(w)), np.zeros(len(w))
            for at in range(0, len(x), 4096):  # in blocks, as the sums need doubles
                block = slice(at, at + 4096)
                part = x[block].astype(np.float64)
                curve += (part.T * (short + above)[block]) @ part
                slope += part.T @ (short * goal - above)[block]
            new = np.linalg.solve(curve, slope)
            w, moved = new, np.abs(new - w).max()
            if moved < 1e-6:
                break
        surprise = np.maximum(surprise, np.where(neg == 0, np.clip(2 * _product(x[: len(words)], w) - 1, 0, 1), 0))
    weights = np.zeros((1 << 18) + 1, np.float32)
    weights[known] = values @ (whiten @ w[:-1])
    weights[-1] = w[-1]
    return weights


def fit_logistic(x: np.ndarray, label: np.ndarray, ridge: float = 0.03) -> tuple[np.ndarray, float, float]:
    """Slopes, offset and floor of the probability: toxic labels without a toxic word are a floor, not a reason for flat slopes.

    Fisher scoring on standardised features for each floor of a short list; the likeliest wins.
    """
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    hold = np.full(z.shape[1], ridge)
    hold[-1] = 1e-4

    def climb(floor: float, use: np.ndarray) -> tuple[float, np.ndarray]:
        w = np.where(np.arange(len(hold)) == 0, 1.0, 0.0)
        w[-1] = -np.quantile(z[:, 0], 1 - label.mean())
        v, keep, w = z[:, use], hold[use], w[use]
        for _ in range(200):
            q = 1 / (1 + np.exp(-np.clip(v @ w, -30, 30)))
            p = np.clip(floor + (1 - floor) * q, 1e-6, 1 - 1e-6)
            d = (1 - floor) * q * (1 - q)
            info = (v.T * (d * d / (p * (1 - p)))) @ v + np.diag(keep)
            move = np.linalg.solve(info, v.T @ ((label - p) * d / (p * (1 - p))) - keep * w)
            w = w + move * min(1.0, 0.5 / max(1e-9, np.abs(move).max()))
        out = np.zeros(len(hold))
        out[use] = w
        return (label * np.log(p) + (1 - label) * np.log(1 - p)).sum() - 0.5 * (keep * w) @ w, out

    best = (-np.inf, np.zeros(x.shape[1]), 0.0, 0.0)
    for floor in (0.0, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12):
        use = np.ones(len(hold), bool)
        while True:  # a worse word never lowers the probability: features with negative slopes go
            fit, w = climb(floor, use)
            wrong = w[:-1] < 0
            if not wrong.any():
                break
            use[:-1] &= ~wrong
        if fit > best[0]:
            slopes = w[:-1] / spread
            best = (fit, slopes, float(w[-1] - slopes @ mean), floor)
    return best[1:]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _evidence(weights: np.ndarray, most_cached: int = 400_000):
    """A function from texts to features: the worst word's score, and for each level the logarithm of 1 and what all words have above it.

    Scores of tokens are kept, up to ``most_cached`` and a batch's.
    """
    cache: dict[str, float] = {}

    def of(texts: list[str | None]) -> np.ndarray:
        if len(cache) > most_cached:
            cache.clear()
        sets = [tokens_of(t) for t in texts]
        new = list(set().union(*sets) - cache.keys()) if sets else []
        for s in range(0, len(new), 20_000):
            some = new[s : s + 20_000]
            parts = [parts_of(t) for t in some]
            scores = word_scores([p for ps in parts for p in ps], weights).tolist()
            at = 0
            for token, ps in zip(some, parts, strict=True):
                cache[token] = max(scores[at : at + len(ps)], default=-1.0)
                at += len(ps)
        out = np.zeros((len(texts), 1 + len(LEVELS)))
        for row, tokens in zip(out, sets, strict=True):
            scores = np.fromiter(map(cache.__getitem__, tokens), float, len(tokens))
            row[0] = scores.max(initial=-1.0)
            row[1:] = [np.log1p(np.maximum(scores - least, 0).sum()) for least in LEVELS]
        return out

    return of


class ToxicityModel:
    """A trained machine: triple weights, and slopes, offset and floor of the probability."""

    def __init__(self, weights: np.ndarray | None, slopes: np.ndarray | None, offset: float, floor: float = 0.0):
        self.weights, self.slopes, self.offset, self.floor = weights, slopes, offset, floor

    def append(self, docs: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
        """``docs`` with the score, 0 to 1, of every row as column ``name``; a null text counts as an empty one."""
        docs = docs.drop(name)
        if self.weights is None:
            return docs.withColumn(name, F.lit(float(1 / (1 + np.exp(-self.offset)))))
        weights, slopes, offset, floor = self.weights, self.slopes, self.offset, self.floor

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            evidence = _evidence(weights)
            for batch in batches:
                for s in range(0, batch.num_rows, 500):
                    part = batch.slice(s, 500)
                    x = evidence(part.column(text).to_pylist())
                    # below the step the floor still rises a little, which keeps the order of texts
                    p = floor / (1 + np.exp(-x[:, 0])) + (1 - floor) / (1 + np.exp(-np.clip(x @ slopes + offset, -300, 300)))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], [*part.schema.names, name])

        return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))

    def score(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id and ``score`` of every row."""
        return self.append(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "score")


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 8_000, max_words: int = 32_000, n_landmarks: int = 384, mining: int = 2) -> ToxicityModel:
    """Train on labelled documents that aren't held out.

    ``max_docs`` labels, those with the smallest hash of their doc_id, make the sample, and
    its ``max_words`` most frequent words the words that are trained on; ``mining`` times the
    ``max_words // 8`` words that score highest though no more toxic than other documents hold
    them join as hard ones. Contradicting labels
    of one doc_id count as toxic; null labels don't count. Where the sample lacks a label the
    model gives every text the share of toxic ones.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("doc_id", "text", F.col("label").cast("int").alias("label"))
    sample = staged(sample, "toxic-sample").repartition(16)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = sorted({p for t in tokens_of(text) for p in parts_of(t)})
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([label] * len(words), pa.int32())], ["word", "label"])

    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = counts.get(1, 0), counts.get(0, 0)
    if not n_pos or not n_neg:
        return ToxicityModel(None, None, float(np.log((n_pos + 0.5) / (n_neg + 0.5))) if n_pos + n_neg else -30.0)
    words = sample.select("text", "label").mapInArrow(words_of, "word string, label int").groupBy("word")
    words = staged(words.agg(F.sum(F.col("label")).alias("pos"), F.sum(1 - F.col("label")).alias("neg")), "toxic-words")
    rows = {r["word"]: r for r in words.orderBy((F.col("pos") / n_pos + F.col("neg") / n_neg).desc(), "word").limit(max_words).collect()}
    if not any(r["pos"] for r in rows.values()) or not any(r["neg"] for r in rows.values()):
        return ToxicityModel(None, None, float(np.log((n_pos + 0.5) / (n_neg + 0.5))))
    hard: set[str] = set()
    for again in range(mining + 1):
        found = sorted(rows.values(), key=lambda r: r["word"])
        pos, neg = (np.array([r[k] for r in found], float) for k in ("pos", "neg"))
        weights = train_machine([r["word"] for r in found], pos, neg, n_pos, n_neg, n_landmarks, np.array([r["word"] in hard for r in found]))
        if again < mining:
            scored = words.filter("neg > 0 and neg >= pos").withColumnRenamed("word", "text").withColumn("doc_id", F.struct("text", "pos", "neg"))
            high = ToxicityModel(weights, np.eye(1 + len(LEVELS))[0], 0.0).score(scored).orderBy(F.col("score").desc(), "doc_id.text").limit(max_words // 8)
            for r in high.select("doc_id.text", "doc_id.pos", "doc_id.neg").withColumnRenamed("text", "word").collect():
                rows[r["word"]] = r
                hard.add(r["word"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = _evidence(weights)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(evidence(batch.column("text").to_pylist()))), batch.column("label")], ["x", "label"])

    raw = sample.select("text", "label").mapInArrow(features, "x array<double>, label int").collect()
    raw.sort(key=lambda r: (r["x"], r["label"]))
    return ToxicityModel(weights, *fit_logistic(np.array([r["x"] for r in raw]), np.array([float(r["label"]) for r in raw])))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    scored = fit(docs, labels).score(docs)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
