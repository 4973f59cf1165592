"""Operator 10: media columns. Texts as grey PNG images in binary columns, and hashes of them.

A row's bytes become the samples of an 8-bit grey image, 64 wide; the image is written as a PNG
(each image row under the filter that leaves the least sum, zlib-compressed chunks, each with its
checksum), read back with the checksums tested and the filters undone in numpy, and described by
which low frequencies of its cosine transform are over their median. Filters are chosen and undone
for all images of a batch at once. Everything is row-wise: one pass over the scan, no shuffle.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_name, in_arrow
from .words import pieces, text_bytes

WIDTH = 64
#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREY, INTERLACE_NONE = 0, 0

GRID, LOW = 32, 8
_COSINE = np.cos(np.pi * (2 * np.arange(GRID)[None, :] + 1) * np.arange(LOW)[:, None] / (2 * GRID))


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _neighbours(samples: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left, upper and upper left sample of each, 0 outside; ``first`` marks images' first rows."""
    left, up = np.zeros_like(samples), np.zeros_like(samples)
    left[:, 1:] = samples[:, :-1]
    up[1:] = samples[:-1]
    up[first] = 0
    corner = np.zeros_like(samples)
    corner[:, 1:] = up[:, :-1]
    return left, up, corner


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of the three (int16) the one nearest to left + up - corner; ties go in that order."""
    to_left, to_up = np.abs(up - corner), np.abs(left - corner)
    to_corner = np.abs(left + up - 2 * corner)
    return np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))


def filtered(samples: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """Rows (1 + width) of images that lie one below the other, each under the filter with the least sum of
    absolute (signed) values; ties go to the lower filter."""
    first = np.cumsum(heights) - heights
    left, up, corner = _neighbours(samples, first)
    wide = [x.astype(np.int16) for x in (left, up, corner)]
    tries = [samples, samples - left, samples - up, samples - (wide[0] + wide[1] >> 1).astype(np.uint8), samples - _paeth(*wide).astype(np.uint8)]
    cost = np.stack([np.abs(t.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64) for t in tries])
    kind = cost.argmin(axis=0)
    out = np.empty((len(samples), samples.shape[1] + 1), np.uint8)
    out[:, 0] = kind
    for k, t in enumerate(tries):
        mine = kind == k
        out[mine, 1:] = t[mine]
    return out


def unfiltered(rows: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """Samples of filtered rows (filters 0 to 4, one byte a sample) of images one below the other.

    A sample needs the ones to its left and above, so all samples of one diagonal of all images are undone
    together: rows are ordered by their place in their image, and diagonal d has the rows d - width + 1 to d.
    """
    total, width = len(rows), rows.shape[1] - 1
    kinds = rows[:, 0]
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    if not kinds.any():
        return rows[:, 1:]
    first = np.repeat(np.cumsum(heights) - heights, heights)
    y = np.arange(total) - first
    order = np.argsort(y, kind="stable")
    place = np.empty(total, np.int64)
    place[order] = np.arange(total)
    y_of, kind = y[order], kinds[order]
    above = np.where(y_of > 0, place[np.maximum(order - 1, 0)], total)  # one more row holds zeros
    coded = rows[order, 1:].ravel()
    line = width + 1
    done = np.zeros((total + 1) * line, np.int16)
    start = np.searchsorted(y_of, np.arange(int(heights.max()) + 1))
    for d in range(int(heights.max()) + width - 1):
        a, z = start[max(0, d - width + 1)], start[min(d + 1, len(start) - 1)]
        if a == z:
            continue
        r = np.arange(a, z)
        x = d - y_of[a:z]
        own, over = r * line + x, above[a:z] * line + x
        left, up, corner = done[own], done[over + 1], done[over]
        k = kind[a:z]
        guess = np.where(k == 1, left, np.where(k == 2, up, np.where(k == 3, left + up >> 1, np.where(k == 4, _paeth(left, up, corner), 0))))
        done[own + 1] = coded[r * width + x] + guess & 255
    return done.reshape(total + 1, line)[place, 1:].astype(np.uint8)


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Samples of one image's filtered rows."""
    return unfiltered(rows, np.array([len(rows)]))


def encoded(rows: np.ndarray, level: int = 1) -> bytes:
    """A PNG of filtered rows."""
    head = struct.pack(">IIBBBBB", rows.shape[1] - 1, len(rows), 8, GREY, 0, 0, INTERLACE_NONE)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def decoded(stored: bytes) -> np.ndarray:
    """The filtered rows of an 8-bit grey PNG; ValueError if a checksum or the form is wrong."""
    if stored[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, packed, ended = 8, None, [], False
    while at < len(stored) and not ended:
        if at + 12 > len(stored):
            raise ValueError("a chunk is cut short")
        (n,), kind = struct.unpack_from(">I", stored, at), stored[at + 4 : at + 8]
        body, check = stored[at + 8 : at + 8 + n], stored[at + 8 + n : at + 12 + n]
        if len(check) < 4 or struct.unpack(">I", check)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of chunk {kind!r} is wrong")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended or head[2:] != (8, GREY, 0, 0, INTERLACE_NONE):
        raise ValueError("not a complete 8-bit grey image")
    width, height = head[:2]
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(rows) != height * (width + 1):
        raise ValueError("wrong number of samples")
    return rows.reshape(height, width + 1)


def write_png(samples: np.ndarray, level: int = 1) -> bytes:
    """A PNG of a (height, width) array of bytes."""
    return encoded(filtered(samples, np.array([len(samples)])), level)


def read_png(stored: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG."""
    return unfilter(decoded(stored))


def shrunk(image: np.ndarray) -> np.ndarray:
    """Means of the image over a GRID x GRID raster; rows repeat where there are too few."""
    height, width = image.shape
    wide = image.reshape(height, GRID, width // GRID).sum(axis=2, dtype=np.int64)
    edge = np.arange(GRID + 1) * height // GRID
    total = np.zeros((height + 1, GRID), np.int64)
    np.cumsum(wide, axis=0, out=total[1:])
    low, high = edge[:-1], np.maximum(edge[1:], edge[:-1] + 1)
    return (total[high] - total[low]) / ((high - low)[:, None] * (width // GRID))


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest cosine frequencies are over their median.

    The constant term is left out of the median, as it only has the brightness.
    """
    low = (_COSINE @ shrunk(image) @ _COSINE.T).round(6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def padded(raw: bytes) -> bytes:
    return raw + bytes(WIDTH - len(raw) % WIDTH if len(raw) % WIDTH or not raw else 0)


def media_columns(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep_image: bool = True) -> DataFrame:
    """One row per row of ``docs``: its text as a PNG, and what was read back from that PNG.

    Columns: the id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, and the image itself as ``media`` (binary) if ``keep_image``. A null text counts as
    empty: 64 zero bytes. A null id stays null; repeated rows give repeated results; other columns
    of ``docs`` are not read. The feature is of the samples read back, so equal texts have equal
    values everywhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            data, at = text_bytes(batch.column("_text"))
            raw, out = data.tobytes(), []
            payloads = [padded(raw[a:z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            heights = np.array([len(p) // WIDTH for p in payloads])
            edge = np.cumsum(heights)[:-1]
            rows = filtered(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH), heights)
            media = [encoded(r) for r in np.split(rows, edge)]
            samples = unfiltered(np.concatenate([decoded(m) for m in media]), heights)
            for n, stored, image in zip(np.diff(at).tolist(), media, np.split(samples, edge), strict=True):
                back = image.tobytes()
                out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(image), stored))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: 8 if keep_image else 7]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *arrays], names=names)

    fields = ["n_bytes long", "payload_bytes long", "payload_sha256 string", "tail_crc32 long", "media_bytes long", "media_sha256 string", "feature string", *["media binary"] * keep_image]
    names = [id_col, *(f.split()[0] for f in fields)]
    rows = docs.select(docs[id_col].alias("_id"), docs[text].cast("string").alias("_text"))
    return in_arrow(rows, run, f"`{id_col}` {rows.schema['_id'].dataType.simpleString()}, " + ", ".join(fields))


def images(media: DataFrame, column: str = "media") -> DataFrame:
    """Adds ``payload`` (binary): the samples of each PNG, read back with all tests. Null stays null.

    If ``media`` has that name already, the new one gets underscores before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [None if x is None else read_png(x).tobytes() for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=[*batch.schema.names, name])

    name = free_name(media, "payload")
    return in_arrow(media, run, T.StructType([*media.schema.fields, T.StructField(name, T.BinaryType())]))
