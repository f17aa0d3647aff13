"""Sampled SentencePiece segmentations: forward filtering and backward sampling over the piece lattice.

A text's lattice falls apart wherever no piece can cross: before a space mark that follows
other text and around characters without a piece. Equal units share one lattice. Forward
filtering sums, for each position of a unit, the weights of all ways to reach it, which gives
each piece that ends there its probability; backward sampling then walks from the end of each
occurrence to its start. Draws depend on the row's key and the position in the text alone, so a
row gets the same pieces in any batch, partition or run. All steps run over whole batches as
arrays. Characters without a piece, line ends and literal space marks among them, become byte
pieces, so decoding restores every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581  # stands for a space in pieces
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


class PieceTable:
    """Pieces by length and hash, their weights, and the bytes that each id decodes to.

    The weight of a piece falls with its rank in the model: 1 / (rank + 2) ** sharpness.
    Equal factors per character cancel within a unit; they keep sums near 1.
    """

    def __init__(self, model: str = MODEL, sharpness: float = 1.0):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model)
        self.byte_id = np.zeros(256, np.int32)
        self.decoded: list[bytes] = []
        by_length: dict[int, list[tuple[int, int]]] = {}
        best = max((m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))), default=0)
        rank = np.zeros(m.get_piece_size())
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.decoded.append(bytes([int(piece[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                self.decoded.append(b"")
            else:
                self.decoded.append(piece.replace(chr(MARK), " ").encode())
                h = 0
                for c in piece:
                    h = (h * int(_BASE) + ord(c) + 1) & _MASK
                by_length.setdefault(len(piece), []).append((h, i))
                rank[i] = best - m.get_score(i)
        self.longest = max(by_length)
        self.weight = (1 / (rank + 2)) ** sharpness
        self.hashes, self.ids = {}, {}
        for length, found in by_length.items():
            found.sort()
            self.hashes[length] = np.array([h for h, _ in found], np.uint64)
            self.ids[length] = np.array([i for _, i in found], np.int32)
        self.single = np.zeros(0x110001, bool)
        for i in self.ids[1]:
            self.single[ord(m.id_to_piece(int(i)))] = True

    def lookup(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 for none."""
        if length not in self.hashes:
            return np.full(len(hashes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.hashes[length], hashes), len(self.hashes[length]) - 1)
        return np.where(self.hashes[length][at] == hashes, self.ids[length][at], -1)


def _prefix_hashes(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of each unit from its start up to each of its positions: one row of length + 1 values after another, flat."""
    out = np.zeros(len(points) + len(starts), np.uint64)
    base = starts + np.arange(len(starts))
    order = np.argsort(-lengths, kind="stable")
    falling = -lengths[order]
    for t in range(int(lengths.max()) if len(lengths) else 0):
        active = order[: np.searchsorted(falling, -t, side="left")]
        at = base[active] + t
        out[at + 1] = out[at] * _BASE + points[starts[active] + t].astype(np.uint64) + np.uint64(1)
    return out


def _draws(seeds: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """A number in [0, 1) from a row's seed and a position in its text."""
    z = seeds + positions.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Lattice:
    """Units side by side; for each node (a position in a unit) the pieces that end there, by their length.

    running: running probability of the pieces' lengths; id: their ids, -2 for a character without a piece.
    """

    def __init__(self, table: PieceTable, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        n = len(starts)
        self.base = starts + np.arange(n)  # a unit has one node more than characters
        hashes = _prefix_hashes(points, starts, lengths)
        unit = np.repeat(np.arange(n), lengths)
        offset = np.arange(len(points)) - starts[unit]
        left, node = lengths[unit] - offset, np.arange(len(points)) + unit
        most = min(table.longest, int(lengths.max()))
        weight = np.zeros((len(points) + n, most), np.float32)
        self.id = np.full((len(points) + n, most), -1, np.int32)
        at = node
        for size in range(1, most + 1):
            longer = left >= size
            at, left = at[longer], left[longer]
            found = table.lookup(hashes[at + size] - hashes[at] * np.uint64(pow(int(_BASE), size, 1 << 64)), size)
            hit = np.flatnonzero(found >= 0)
            end, found = at[hit] + size, found[hit]
            weight[end, size - 1] = table.weight[found] * 10.0**size
            self.id[end, size - 1] = found
        lone = node[~table.single[points]] + 1
        weight[lone, 0], self.id[lone, 0] = 1, -2
        reach = np.zeros(len(points) + n)
        reach[self.base] = 1
        order = np.argsort(-lengths, kind="stable")
        falling, back = -lengths[order], np.arange(1, most + 1)
        for t in range(1, int(lengths.max()) + 1):
            active = order[: np.searchsorted(falling, -t, side="right")]
            here, m = self.base[active] + t, min(most, t)
            flow = np.cumsum(reach[here[:, None] - back[:m]] * weight[here, :m], axis=1)
            total = flow[:, -1]
            reach[here] = total
            weight[here, :m] = flow / total[:, None]
            weight[here, m - 1 :] = 2
            if t % 32 == 0:  # long units would leave the range of a double
                near = here[:, None] - np.arange(m)
                reach[near] /= total[:, None]
        self.running = weight


def encode(table: PieceTable, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled ids of all texts in one array, and where each text's ids begin and end."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    lengths = np.array([len(r) + 1 if len(r) else 0 for r in raw])
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    real = np.full(bounds[-1], 0x20, np.int32)
    for r, s in zip(raw, bounds, strict=False):
        if len(r):
            real[s + 1 : s + 1 + len(r)] = r
    points = np.where(real == 0x20, MARK, np.where(real == MARK, 0x110000, real))
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    mark, lone = points == MARK, ~table.single[points]
    cut = (mark & ~np.roll(mark, 1)) | lone | np.roll(lone, 1)
    cut[bounds[:-1][lengths > 0]] = True
    starts = np.flatnonzero(cut)
    sizes = np.diff(np.append(starts, len(points)))
    hashes = _prefix_hashes(points, starts, sizes)[starts + np.arange(len(starts)) + sizes]
    _, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
    u_sizes = sizes[sample]
    u_starts = np.concatenate([[0], np.cumsum(u_sizes)])[:-1]
    place = np.repeat(starts[sample] - u_starts, u_sizes) + np.arange(u_sizes.sum())
    lattice = Lattice(table, points[place], u_starts, u_sizes)
    row = np.repeat(np.arange(len(texts)), lengths)[starts]
    at, base = sizes.copy(), lattice.base[which]
    out = np.full(len(points), -1, np.int32)
    alive = np.arange(len(starts))
    while len(alive):
        here = at[alive]
        x = _draws(seeds[row[alive]], starts[alive] + here - bounds[row[alive]]).astype(np.float32)
        node = base[alive] + here
        size = (lattice.running[node] <= x[:, None]).sum(axis=1) + 1
        here = here - size
        out[starts[alive] + here] = lattice.id[node, size - 1]
        at[alive] = here
        alive = alive[here > 0]
    chosen = np.flatnonzero(out != -1)
    ids = out[chosen]
    fallback = np.flatnonzero(ids == -2)
    if len(fallback):
        encoded = [chr(real[i]).encode("utf-8", "surrogatepass") for i in chosen[fallback]]
        width = np.ones(len(ids), np.int64)
        width[fallback] = [len(b) for b in encoded]
        ends = np.cumsum(width)
        ids = np.repeat(ids, width)
        begin = ends[fallback] - width[fallback]
        spots = np.repeat(begin - np.concatenate([[0], np.cumsum(width[fallback])])[:-1], width[fallback]) + np.arange(width[fallback].sum())
        ids[spots] = table.byte_id[np.frombuffer(b"".join(encoded), np.uint8)]
        counts = np.concatenate([[0], ends])
    else:
        counts = np.arange(len(ids) + 1)
    return ids, counts[np.searchsorted(chosen, bounds)]


def decode(table: PieceTable, ids: list[int]) -> str:
    text = b"".join(map(table.decoded.__getitem__, ids)).decode("utf-8", "surrogatepass")
    return text[1:]  # the mark in front


def sample_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: str | None = None, seed: int = 0, sharpness: float = 1.0, model: str = MODEL, check: bool = True, block: int = 2_000_000) -> DataFrame:
    """doc_id, ``tokens`` (array of ids), ``n_tokens`` and ``lossless`` (whether decoding restores the text) of every row.

    Draws are seeded by ``key`` (doc_id unless named) and ``seed``; rows that agree in key and
    text get the same tokens. A null text has null tokens, none counted, and an empty one an
    empty array; both are lossless. A null key is a key of its own. Other columns are ignored.
    ``block`` bounds the characters that are worked on at once, but for a longer single text.
    """
    table = PieceTable(model, sharpness)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(key or doc_id).cast("string"), F.lit(seed)).alias("seed"))

    def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy()
        ends, s = np.cumsum(sizes), 0
        while s < batch.num_rows:
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + block, side="right")))
            yield batch.slice(s, e - s)
            s = e

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                texts = part.column("text").to_pylist()
                ids, bounds = encode(table, [t or "" for t in texts], part.column("seed").to_numpy().view(np.uint64))
                void = pa.array([t is None for t in texts])
                tokens = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()), mask=void)
                if check:
                    flat = ids.tolist()
                    lossless = [decode(table, flat[s:e]) == (t or "") for t, s, e in zip(texts, bounds, bounds[1:], strict=False)]
                else:
                    lossless = [None] * len(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), tokens, pa.array(np.diff(bounds), pa.int64()), pa.array(lossless, pa.bool_())], ["doc_id", "tokens", "n_tokens", "lossless"])

    return rows.mapInArrow(sampled, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, tokens array<int>, n_tokens long, lossless boolean")


def decode_pieces(encoded: DataFrame, doc_id: str = "doc_id", tokens: str = "tokens", model: str = MODEL) -> DataFrame:
    """doc_id and ``text`` of rows of ids; null ids give a null text."""
    table = PieceTable(model)
    rows = encoded.select(F.col(doc_id).alias("doc_id"), F.col(tokens).alias("tokens"))

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else decode(table, ids) for ids in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(restored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
