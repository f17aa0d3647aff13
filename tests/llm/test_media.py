"""AVI films: exact round trips, a plain bit-by-bit decoder, shots, edge rows."""

import hashlib
import random
import zlib

import numpy as np

from rowloom.llm import media


def slow_decode(jpeg):
    """Samples of one frame, bit by bit, from its own Huffman table."""
    at = jpeg.index(b"\xff\xc4") + 5
    counts, codes, code, k = jpeg[at : at + 16], {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[(length, code)] = jpeg[at + 16 + k]
            code, k = code + 1, k + 1
        code <<= 1
    scan = jpeg[jpeg.index(b"\xff\xda") + 10 : -2]
    lines, line, i = [], bytearray(), 0
    while i < len(scan):
        if scan[i] == 255 and scan[i + 1]:
            lines.append(line)
            line, i = bytearray(), i + 2
        else:
            line.append(scan[i])
            i += 2 if scan[i] == 255 else 1
    out = []
    for line in [*lines, line]:
        bits, p, value = "".join(f"{b:08b}" for b in line), 0, 128
        for _ in range(media.SIDE):
            n = 1
            while (n, int(bits[p : p + n], 2)) not in codes:
                n += 1
            size = codes[(n, int(bits[p : p + n], 2))]
            extra = int(bits[p + n : p + n + size] or "0", 2)
            value += extra if not size or extra >> (size - 1) else extra - (1 << size) + 1
            p += n + size
            out.append(value)
    return bytes(out)


def test_frames():
    rnd = random.Random(1)
    texts = ["", None, "é" * 1000, "".join(chr(rnd.choice([65, 97, 255, 0, 0x1F600])) for _ in range(3000)), "a" * 576, "b" * 577]
    files = media.encode_avis(texts)
    for text, file in zip(texts, files, strict=True):
        frames = [slow_decode(file[a:b]) for a, b in media.frames_of(file)]
        assert b"".join(frames) == media.payload_of(text)
        assert file[:4] == b"RIFF" and int.from_bytes(file[4:8], "little") == len(file) - 8


def test_random_samples():
    rng = np.random.default_rng(2)
    samples = rng.integers(0, 256, 576 * 40).astype(np.uint8)
    samples[: 576 * 10] = rng.choice([0, 255], 576 * 10)
    data, bounds = media.encode_frames(samples)
    sizes = data[bounds[:-1, None] + np.arange(4, 8)].copy().view("<u4").ravel().astype(np.int64)
    assert (media.decode_frames(data, bounds[:-1] + 8, bounds[:-1] + 8 + sizes).ravel() == samples).all()


def test_shots():
    flat = lambda v: np.full((12, 576), v, np.uint8)
    frames = np.concatenate([flat(10), flat(200), flat(90), flat(90)])
    assert np.flatnonzero(media.shots(frames, np.array([0, 36]))).tolist() == [0, 12, 24, 36]


def test_films(spark):
    rows = [(i, t, 5) for i, t in enumerate([None, "", "x", "word " * 60_000, "word " * 60_000, "ü\x00😀"])] + [(2, "x", 5), (None, "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media int")
    got = media.read_avi(media.to_avi(docs)).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        payload = media.payload_of(texts[r["doc_id"]])
        assert r["n_bytes"] == len((texts[r["doc_id"]] or "").encode())
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert media.read_avi(media.to_avi(docs.limit(0))).count() == 0
    assert media.clip_rows(media.read_avi(media.to_avi(docs))).count() >= len(rows)
