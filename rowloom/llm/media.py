"""Texts as AVI motion-JPEG: lossless intra frames, RIFF indexes, and shots as timed clip rows.

A payload becomes frames of 24 x 24 samples, each a lossless JPEG (process 14, predictor 1,
8-bit samples, one restart interval per line). Baseline JPEG would round the samples, so the
lossless process of the same standard is used. As every line restarts, all lines of a
block of documents are coded and decoded side by side as arrays. A reader finds the frames by
the file's idx1 index, decodes them, and compares histograms of neighbouring frames: a
difference well above those just before, measured by their mean and deviation, starts a shot.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
FILL = 255
#: Code lengths by size category 0 to 8 of a difference (fixed values; no code is all ones).
LENGTHS = {5: 2, 6: 2, 3: 3, 4: 3, 7: 3, 2: 4, 0: 5, 1: 6, 8: 7}


def _codes() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """For each difference + 255 its code and length; for each 15 bits ahead the difference and length; the table's segment."""
    order = sorted(LENGTHS, key=lambda c: (LENGTHS[c], c))
    code, last, table = 0, LENGTHS[order[0]], {}
    for c in order:
        code <<= LENGTHS[c] - last
        last = LENGTHS[c]
        table[c] = code
        code += 1
    bits, sizes = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    ahead, taken = np.zeros(1 << 15, np.int16), np.zeros(1 << 15, np.uint8)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        bits[d + 255] = (table[c] << c) | (d if d >= 0 else d + (1 << c) - 1)
        sizes[d + 255] = n = LENGTHS[c] + c
        start = int(bits[d + 255]) << (15 - n)
        ahead[start : start + (1 << (15 - n))] = d
        taken[start : start + (1 << (15 - n))] = n
    per_length = bytes(sum(1 for c in order if LENGTHS[c] == n) for n in range(1, 17))
    return bits, sizes, ahead, taken, b"\xff\xc4" + struct.pack(">HB", 19 + len(order), 0) + per_length + bytes(order)


BITS, SIZES, AHEAD, TAKEN, DHT = _codes()
HEAD = np.frombuffer(
    b"\xff\xd8" + DHT + b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, SIDE, SIDE, 1) + b"\x01\x11\x00" + b"\xff\xdd" + struct.pack(">HH", 4, SIDE) + b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00\x01\x00\x00",
    np.uint8,
)


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, filled up to a positive multiple of a frame."""
    body = (text or "").encode("utf-8", "surrogatepass")
    return body + bytes([FILL]) * (max(FRAME, -(-len(body) // FRAME) * FRAME) - len(body))


def encode_frames(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """AVI chunks (id, size, JPEG, fill to even length) of all frames in one array, and where each begins and ends."""
    n = len(samples) // FRAME
    lines = samples.reshape(-1, SIDE).astype(np.int16)
    diffs = np.diff(lines, axis=1, prepend=np.int16(128)) + 255
    sizes = SIZES[diffs]
    at = np.cumsum(sizes, axis=1)
    n_bytes = (at[:, -1] + 7) >> 3
    begin = np.concatenate([[0], np.cumsum(n_bytes)])
    packed = np.zeros(begin[-1] + 4, np.uint8)
    for i in range(SIDE):  # lines don't share bytes, so each step writes every byte once
        end = at[:, i]
        first = end - sizes[:, i]
        spot = begin[:-1] + (first >> 3)
        word = BITS[diffs[:, i]] << (24 - sizes[:, i] - (first & 7)).astype(np.uint32)
        packed[spot] |= (word >> 16).astype(np.uint8)
        packed[spot + 1] |= np.where(end > ((first >> 3) + 1) * 8, word >> 8 & 255, 0).astype(np.uint8)
        packed[spot + 2] |= np.where(end > ((first >> 3) + 2) * 8, word & 255, 0).astype(np.uint8)
    packed[begin[1:] - 1] |= ((1 << (n_bytes * 8 - at[:, -1])) - 1).astype(np.uint8)
    packed = packed[: begin[-1]]
    full = packed == 255
    stuffed = np.concatenate([[0], np.cumsum(full)])
    # a line takes its bytes, the zeros after its bytes of ones, and a restart marker, the frame's end after the last
    line_size = n_bytes + stuffed[begin[1:]] - stuffed[begin[:-1]] + 2
    body = line_size.reshape(n, SIDE).sum(axis=1) + len(HEAD)
    chunk = 8 + body + (body & 1)
    bounds = np.concatenate([[0], np.cumsum(chunk)])
    out = np.zeros(bounds[-1], np.uint8)
    out[bounds[:-1, None] + np.arange(4)] = np.frombuffer(b"00dc", np.uint8)
    out[bounds[:-1, None] + np.arange(4, 8)] = body.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[bounds[:-1, None] + np.arange(8, 8 + len(HEAD))] = HEAD
    inner = np.cumsum(line_size.reshape(n, SIDE), axis=1) - line_size.reshape(n, SIDE)
    line_at = (bounds[:-1, None] + 8 + len(HEAD) + inner).ravel()
    shift = line_at - begin[:-1] - stuffed[begin[:-1]]
    out[np.arange(len(packed)) + stuffed[:-1] + np.repeat(shift, n_bytes)] = packed
    mark = line_at + line_size - 2
    out[mark] = 255
    out[mark + 1] = np.tile(np.append(0xD0 + np.arange(SIDE - 1) % 8, 0xD9), n)
    return out, bounds


def avi(chunks: bytes, sizes: np.ndarray) -> bytes:
    """An AVI file around the chunks of its frames; sizes: those of the JPEG data."""
    n = len(sizes)
    padded = sizes + (sizes & 1) + 8
    index = np.zeros(n, dtype=[("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    index["id"], index["flags"], index["size"] = b"00dc", 16, sizes
    index["at"] = 4 + np.cumsum(padded) - padded
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 16, n, 0, 1, int(sizes.max()), SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, n, int(sizes.max()), 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)

    def chunk(name: bytes, data: bytes) -> bytes:
        return name + struct.pack("<I", len(data)) + data

    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl)
    body = b"AVI " + hdrl + chunk(b"LIST", b"movi" + chunks) + chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def encode_avis(texts: list[str | None]) -> list[bytes]:
    payloads = [payload_of(t) for t in texts]
    out, bounds = encode_frames(np.frombuffer(b"".join(payloads), np.uint8))
    sizes = out[bounds[:-1, None] + np.arange(4, 8)].copy().view("<u4").ravel().astype(np.int64)
    data, files, f = out.tobytes(), [], 0
    for p in payloads:
        n = len(p) // FRAME
        files.append(avi(data[bounds[f] : bounds[f + n]], sizes[f : f + n]))
        f += n
    return files


def frames_of(file: bytes) -> list[tuple[int, int]]:
    """Begin and end of each frame's JPEG data, by the idx1 index."""
    if file[:4] != b"RIFF" or file[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, found = 12, None, None
    while at + 8 <= len(file):
        name, (size,) = file[at : at + 4], struct.unpack_from("<I", file, at + 4)
        if name == b"LIST" and file[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            found = np.frombuffer(file, dtype=[("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")], count=size // 16, offset=at + 8)
        at += 8 + size + (size & 1)
    if movi is None or found is None:
        raise ValueError("no frames or no index")
    begin = movi + found["at"].astype(np.int64) + 8
    return list(zip(begin.tolist(), (begin + found["size"]).tolist(), strict=True))


def decode_frames(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Samples of the JPEG frames at data[begin:end], a row for each frame."""
    n = len(begin)
    if not (data[begin[:, None] + np.arange(len(HEAD))] == HEAD).all():
        raise ValueError("a frame of another make")
    scan = begin + len(HEAD)
    sizes = end - 2 - scan
    starts = np.concatenate([[0], np.cumsum(sizes)])
    body = data[np.repeat(scan - starts[:-1], sizes) + np.arange(starts[-1])]
    after = np.zeros(len(body), bool)  # bytes that follow a byte of ones
    after[1:] = body[:-1] == 255
    marker = after & (body >= 0xD0) & (body <= 0xD7)
    drop = after & (body == 0) | marker
    drop[:-1] |= marker[1:]
    kept = np.concatenate([[0], np.cumsum(~drop)])
    lines = np.sort(np.concatenate([starts[:-1], np.flatnonzero(marker) + 1]))
    if len(lines) != n * SIDE:
        raise ValueError("restart markers are missing")
    packed = np.concatenate([body[~drop], np.zeros(4, np.uint8)]).astype(np.uint32)
    words = (packed[:-3] << 24) | (packed[1:-2] << 16) | (packed[2:-1] << 8) | packed[3:]
    bit = kept[lines] * 8
    out = np.empty((len(lines), SIDE), np.uint8)
    value = np.full(len(lines), 128, np.int16)
    for i in range(SIDE):
        ahead = (words[bit >> 3] >> (17 - (bit & 7)).astype(np.uint32)) & 0x7FFF
        value = value + AHEAD[ahead]
        bit = bit + TAKEN[ahead]
        out[:, i] = value
    return out.reshape(n, FRAME)


def shots(frames: np.ndarray, first: np.ndarray, window: int = 8, least: int = 58) -> np.ndarray:
    """Which frames start a shot; first: the first frame of each film.

    Histograms of 16 classes; a difference counts as a cut if it is ``least`` or more and above
    the mean of up to ``window`` differences before it by three deviations. In whole numbers,
    so that a film's shots don't depend on its neighbours in a batch.
    """
    n = len(frames)
    bins = np.bincount((np.arange(n)[:, None] * 16 + (frames >> 4)).ravel(), minlength=n * 16).reshape(n, 16)
    diff = np.concatenate([[0], np.abs(np.diff(bins, axis=0)).sum(axis=1)]).astype(np.int64)
    start = np.zeros(n, np.int64)
    start[first] = first
    start = np.maximum.accumulate(start)
    diff[first] = 0
    s1, s2 = np.concatenate([[0], np.cumsum(diff)]), np.concatenate([[0], np.cumsum(diff * diff)])
    here = np.arange(n)
    low = np.maximum(start + 1, here - window)
    k = np.maximum(here - low, 0)
    low = here - k
    a, b = s1[here] - s1[low], s2[here] - s2[low]
    above = k * diff - a
    cut = (diff >= least) & ((k == 0) | (above > 0) & (above * above > 9 * (k * b - a * a)))
    cut[first] = True
    return cut


def _blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    ends, s = np.cumsum(sizes), 0
    while s < len(sizes):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + most, side="right")))
        yield s, e
        s = e


def to_avi(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = 2_000_000) -> DataFrame:
    """doc_id, ``n_bytes`` and ``media``, an AVI file, of every row.

    A null text counts as an empty one, whose film is one frame of filling. Repeated rows each
    get a film; other columns are ignored. A file's sizes have 32 bits, so a text may hold
    about 3 GB. ``block`` bounds the bytes that are coded at once, but for a longer single text.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sizes = np.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], np.int64)
            for s, e in _blocks(np.maximum(sizes, FRAME), block):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s, e - s), pa.array(sizes[s:e]), pa.array(encode_avis(texts[s:e]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(coded, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


FILM = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips array<struct<start_ms:long,end_ms:long,mean:double>>"


def read_avi(films: DataFrame, block: int = 6_000_000) -> DataFrame:
    """Films of to_avi() read back: size and hashes of the payload and the file, and the clips between cuts.

    A null film gives nulls.
    """

    def read(files: list[bytes]) -> Iterator[tuple]:
        spans = [frames_of(f) for f in files]
        starts = np.concatenate([[0], np.cumsum([len(f) for f in files])])
        begin = np.concatenate([np.array(x, np.int64).reshape(-1, 2)[:, 0] + s for x, s in zip(spans, starts, strict=False)])
        end = np.concatenate([np.array(x, np.int64).reshape(-1, 2)[:, 1] + s for x, s in zip(spans, starts, strict=False)])
        frames = decode_frames(np.frombuffer(b"".join(files), np.uint8), begin, end)
        counts = np.array([len(x) for x in spans])
        first = np.cumsum(counts) - counts
        cut, sums = np.flatnonzero(shots(frames, first)), np.concatenate([[0], np.cumsum(frames.sum(axis=1, dtype=np.int64))])
        samples = frames.tobytes()
        for file, f, n in zip(files, first.tolist(), counts.tolist(), strict=True):
            payload = samples[f * FRAME : (f + n) * FRAME]
            edges = [*cut[np.searchsorted(cut, f) : np.searchsorted(cut, f + n)].tolist(), f + n]
            ms = 1000 // FPS
            clips = [{"start_ms": (a - f) * ms, "end_ms": (b - f) * ms, "mean": float(sums[b] - sums[a]) / ((b - a) * FRAME)} for a, b in zip(edges, edges[1:], strict=False)]
            yield len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), clips

    clip_type = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("mean", pa.float64())]))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), clip_type]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips"]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column("media").to_pylist()
            for s, e in _blocks(np.array([len(f or b"") for f in files], np.int64), block):
                known = [f for f in files[s:e] if f is not None]
                facts = iter(read(known)) if known else iter(())
                rows = [next(facts) if f is not None else (None,) * 6 for f in files[s:e]]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s, e - s), batch.column("n_bytes").slice(s, e - s), *columns], ["doc_id", "n_bytes", *names])

    return films.select("doc_id", "n_bytes", "media").mapInArrow(decoded, f"doc_id {films.schema['doc_id'].dataType.simpleString()}, {FILM}")


def clip_rows(read: DataFrame) -> DataFrame:
    """A row for each clip: doc_id, clip, start_ms, end_ms, mean."""
    return read.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")
