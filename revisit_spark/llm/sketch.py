"""Which cells of a sketch are hit twice or more, merged from sketches of single tasks.

A task keeps two bits for each cell (hit; hit again) and sends them in parts of 2**16 cells, each as the
places of its set bits (two bytes for one) or, where these would take more, as all of its bits. So what is
shuffled follows the hits, at two bytes each, and never exceeds a task's two bitmaps. Parts are
dealt by their number and merged one after the other: a merging task holds its own parts alone,
however many tasks have sent some.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow

#: Bits for a place within a part, so that places have two bytes; a part's bitmap has 8 KB.
PART = 16
PART_BYTES = 1 << PART - 3


def _by_byte(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ascending, distinct cells: each one's bit, the first cell of each byte, and these bytes."""
    bit = np.uint8(1) << (cells & 7).astype(np.uint8)
    byte = cells >> 3
    first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
    return bit, first, byte[first]


def add(once: np.ndarray, again: np.ndarray, cells: np.ndarray) -> None:
    """Hits of ``cells``, put into the packed bitmaps of cells hit and hit again."""
    if not len(cells):
        return
    cell, n = np.unique(cells.astype(np.int64), return_counts=True)
    bit, first, at = _by_byte(cell)
    own = np.bitwise_or.reduceat(bit, first)
    again[at] |= np.bitwise_or.reduceat(np.where(n > 1, bit, np.uint8(0)), first) | once[at] & own
    once[at] |= own


def pack(part: np.ndarray) -> bytes:
    """A part's bits: the places of those set, or the bitmap, whichever is shorter."""
    filled = np.flatnonzero(part)
    bits = np.unpackbits(part[filled], bitorder="little").reshape(-1, 8)
    if 2 * int(bits.sum()) >= PART_BYTES:
        return part.tobytes()
    of, bit = np.nonzero(bits)
    return (filled[of] * 8 + bit).astype("<u2").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    if len(packed) == PART_BYTES:
        return np.frombuffer(packed, np.uint8)
    out = np.zeros(PART_BYTES, np.uint8)
    if packed:
        bit, first, at = _by_byte(np.frombuffer(packed, "<u2").astype(np.int64))
        out[at] = np.bitwise_or.reduceat(bit, first)
    return out


def _own_parts(cells_of: Callable, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(1 << bits - 3, np.uint8), np.zeros(1 << bits - 3, np.uint8)
        for cells in cells_of(batches):
            add(once, again, cells)
        one, two = once.reshape(-1, PART_BYTES), again.reshape(-1, PART_BYTES)
        hit = np.flatnonzero(one.any(axis=1))
        for few in (hit[i : i + 128] for i in range(0, len(hit), 128)):
            sent = [pa.array([pack(x[p]) for p in few.tolist()], pa.binary()) for x in (one, two)]
            yield pa.RecordBatch.from_arrays([pa.array(few.astype(np.int32)), *sent], names=["part", "once", "again"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for part, one, two in zip(*(batch.column(c) for c in ("part", "once", "again")), strict=True):
            hit, more = unpack(one.as_py()), unpack(two.as_py())
            if part.as_py() not in parts:
                parts[part.as_py()] = hit.copy(), more.copy()
                continue
            once, again = parts[part.as_py()]
            again |= more | once & hit
            once |= hit
    filled = [(p, again) for p, (_, again) in parts.items() if again.any()]
    for few in (filled[i : i + 128] for i in range(0, len(filled), 128)):
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in few], pa.int32()), pa.array([a.tobytes() for _, a in few], pa.binary())], names=["part", "again"])


def repeated_cells(rows: DataFrame, cells_of: Callable, bits: int) -> np.ndarray:
    """A packed bitmap of the cells (0 to 2**bits - 1) that all tasks together hit twice or more.

    ``cells_of`` makes arrays of cells (uint64) of a task's record batches. A task holds two bitmaps and the
    driver gets one, 2**bits / 8 bytes each. Counts are exact up to two; the order of rows and tasks doesn't matter.
    """
    bits = max(bits, PART)
    sent = in_arrow(rows, _own_parts(cells_of, bits), "part int, once binary, again binary")
    merged = in_arrow(sent.repartition("part"), _merged, "part int, again binary").toArrow()
    out = np.zeros((1 << bits - PART, PART_BYTES), np.uint8)
    for part, again in zip(merged.column("part").to_pylist(), merged.column("again"), strict=True):
        out[part] = np.frombuffer(again.as_buffer(), np.uint8)
    return out.reshape(-1)
