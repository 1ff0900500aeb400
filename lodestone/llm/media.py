"""Media columns: PNG written and read with zlib and numpy, with perceptual hashes.

A payload of whole 64-sample rows becomes an 8-bit greyscale PNG: signature, IHDR, IDAT, IEND, each chunk with its
CRC. Reading tests the signature and every chunk's checksum, inflates, and undoes the five filter types in numpy.
The feature is a 64-bit hash: the signs, against their median, of the low frequencies of the cosine transform of the
image's 32 x 32 block means.

Edge cases: a null text is empty; an empty text becomes one row of 64 zero bytes. A damaged image raises ValueError.
Empty tables give no rows. Repeated rows and ties of doc_id give a row each; equal texts give equal images. A very long
text is one tall image, held whole by the task that makes or reads it. Only doc_id and text are read, so other columns
cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ids_and_text, map_batches, table, texts_of

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filter_rows(rows: np.ndarray) -> np.ndarray:
    """Rows with their filter byte: none, sub or up, whichever gives an image the least sum of absolute differences."""
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    least, kind = min((int(np.abs(x.view(np.int8).astype(np.int16)).sum()), k) for k, x in ((0, rows), (1, sub), (2, up)))
    return np.concatenate([np.full((len(rows), 1), kind, np.uint8), (rows, sub, up)[kind]], axis=1)


def encode_png(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filter_rows(rows).tobytes(), level)) + _chunk(b"IEND", b"")


def _paeth_row(row: np.ndarray, above: np.ndarray) -> np.ndarray:
    out, a, c = np.empty_like(row), 0, 0
    for i, (x, b) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
        pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        a = (x + (a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c)) & 255
        out[i], c = a, b
    return out


def unfilter(raw: np.ndarray) -> np.ndarray:
    """Undoes the filters of rows (first column: the type). Runs of one type are undone together where they can be."""
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        above = rows[lo - 1] if lo else np.zeros(rows.shape[1], np.uint8)
        kind = int(kinds[lo])
        if kind == 1:
            np.cumsum(rows[lo:hi], axis=1, dtype=np.uint8, out=rows[lo:hi])
        elif kind == 2:
            rows[lo] += above
            np.cumsum(rows[lo:hi], axis=0, dtype=np.uint8, out=rows[lo:hi])
        elif kind in (3, 4):
            for i in range(lo, hi):
                if kind == 4:
                    rows[i] = _paeth_row(rows[i], above)
                else:
                    left = 0
                    for j, (x, b) in enumerate(zip(rows[i].tolist(), above.tolist(), strict=True)):
                        left = (x + (left + b) // 2) & 255
                        rows[i, j] = left
                above = rows[i]
        elif kind:
            raise ValueError(f"filter type {kind}")
    return rows


def decode_png(data: bytes) -> np.ndarray:
    """The samples (height x width) of an 8-bit greyscale PNG; ValueError where it is damaged."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, body, head, ended = 8, [], None, False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut off")
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part, crc = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or zlib.crc32(kind + part) != struct.unpack(">I", crc)[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        ended, at = kind == b"IEND", at + 12 + n
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit greyscale image")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if raw.size != head[1] * (head[0] + 1):
        raise ValueError("wrong size")
    return unfilter(raw.reshape(head[1], head[0] + 1))


_SIDE, _LOW = 32, 8
_COS = np.cos(np.pi / _SIDE * (np.arange(_SIDE) + 0.5)[None, :] * np.arange(_LOW)[:, None])


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits: the signs of the 8 x 8 lowest frequencies against their median (the constant one left out)."""
    h, w = image.shape
    # block means over 32 x 32 cells; where there are fewer rows than cells, a row counts for several cells
    cell = lambda n: (np.arange(_SIDE) * n // _SIDE, np.maximum((np.arange(_SIDE) + 1) * n // _SIDE, np.arange(_SIDE) * n // _SIDE + 1))
    (r0, r1), (c0, c1) = cell(h), cell(w)
    total = np.zeros((h + 1, w), np.int64)
    np.cumsum(image, axis=0, dtype=np.int64, out=total[1:])
    down = np.zeros((_SIDE, w + 1), np.int64)
    np.cumsum(total[r1] - total[r0], axis=1, out=down[:, 1:])
    mean = (down[:, c1] - down[:, c0]) / ((r1 - r0)[:, None] * (c1 - c0)[None, :])
    low = np.round(_COS @ mean @ _COS.T, 6).ravel()
    low[0] = 0
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the PNG)."""

    def make():
        def f(b: pa.RecordBatch) -> dict:
            got = [payload_of(x) for x in texts_of(b)]
            return {"doc_id": b.column("doc_id"), "n_bytes": [n for n, _ in got], "media": [encode_png(p) for _, p in got]}

        return f

    return map_batches(ids_and_text(docs), make, "doc_id long, n_bytes long, media binary", 128)


def read_media(media: DataFrame) -> DataFrame:
    """Adds what is read back from `media`: the payload's size and digests, and the feature."""

    def make():
        def f(b: pa.RecordBatch) -> dict:
            out: dict = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for m in b.column("media").to_pylist():
                image = decode_png(m)
                raw = image.tobytes()
                for k, v in zip(out, (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(m), hashlib.sha256(m).hexdigest(), cosine_hash(image)), strict=True):
                    out[k].append(v)
            return {"doc_id": b.column("doc_id"), "n_bytes": b.column("n_bytes"), **out}

        return f

    return map_batches(media, make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", 128)


def op4_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(to_media(table(spark, sf_dir, "documents")))


QUERIES = {"op4_media_png": op4_media_png}
