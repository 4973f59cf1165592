"""Words of a batch of texts as numpy arrays, for the operators that work on word sequences.

Texts stay UTF-8 bytes. One pass finds the words of all texts of a batch and gives each a 64-bit
hash; n-grams and windows are then arithmetic on those hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD1342543DE82EF95
_BLOCK = 1 << 18

_SPACES = bytes([0x20, *range(0x09, 0x0E)])


def _table(word_bytes, lower: bool) -> np.ndarray:
    """Byte to the value that is hashed; 0 separates words."""
    t = np.zeros(256, np.uint16)
    for b in range(256):
        c = b + 32 if lower and 0x41 <= b <= 0x5A else b
        if word_bytes(c):
            t[b] = c + 1
    return t


#: Words are runs of anything but the six ASCII spaces.
PLAIN = _table(lambda c: c not in _SPACES, lower=False)
#: The same, with A-Z lower-cased.
FOLDED = _table(lambda c: c not in _SPACES, lower=True)
#: Runs of a-z, 0-9 and all that isn't ASCII, with A-Z lower-cased.
ALNUM = _table(lambda c: c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A, lower=True)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_pow = _powers(_BASE, 4096)
_inv = _powers(pow(_BASE, -1, 1 << 64), 4096)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    global _pow, _inv
    if len(_pow) < n:
        m = 1 << (n - 1).bit_length()
        _pow, _inv = _powers(_BASE, m), _powers(pow(_BASE, -1, 1 << 64), m)
    return _pow, _inv


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """``at[i]:at[i+1]`` are text i's words; hash, first byte and end byte of each."""

    at: np.ndarray
    hash: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    data: np.ndarray

    def of(self, i: int) -> list[bytes]:
        raw = self.data
        return [raw[b:e].tobytes() for b, e in zip(self.begin[self.at[i] : self.at[i + 1]], self.end[self.at[i] : self.at[i + 1]], strict=True)]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def left(self) -> np.ndarray:
        """For each word, how many words of its text begin with it: itself and those after it."""
        return np.repeat(self.at[1:], self.counts) - np.arange(len(self.hash))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n+1 offsets of its texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(texts: pa.Array, table: np.ndarray) -> Words:
    """Words of each text under a byte table (PLAIN, FOLDED, ALNUM). Null and empty have none."""
    data, at = text_bytes(texts)
    value = table[data]
    inside = value != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < len(data))]  # a text's end also ends its word
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):  # blocks bound the 8 bytes that each byte takes here
        j = max(i + 1, int(np.searchsorted(end, begin[i] + _BLOCK)))
        a, z = begin[i], end[j - 1]
        pw, inv = powers(int(z - a) + 1)
        total = np.zeros(z - a + 1, np.uint64)
        np.cumsum(value[a:z] * pw[: z - a], out=total[1:])
        b = begin[i:j] - a
        out[i:j] = (total[end[i:j] - a] - total[b]) * inv[b]
        i = j
    return Words(np.searchsorted(begin, at), mixed(out + np.uint64(1)), begin, end, data)


def grams(w: Words, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and whether its text has so many."""
    ok = w.left() >= n
    h = mixed(w.hash + np.uint64(seed * _STEP & (1 << 64) - 1))
    if n == 1:
        return h, ok
    out = np.zeros(len(h), np.uint64)
    if n <= 4:
        m = len(h) - n + 1
        if m > 0:
            acc = h[:m].copy()
            for k in range(1, n):
                acc = acc * np.uint64(_BASE) + h[k : k + m]
            out[:m] = acc
    else:
        pw, inv = powers(len(h) + 1)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * pw[: len(h)], out=total[1:])
        m = len(h) - n + 1
        if m > 0:
            out[:m] = (total[n:] - total[:m]) * inv[:m]
    return mixed(out + np.uint64(n)), ok


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about a MB of text, so that memory doesn't follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most_bytes, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def ragged(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array from flat values and the n+1 offsets of its lists."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


def runs(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... (length[0] of them), begin[1], ..."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(begin - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    return shift + np.arange(total)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of x[i:i+width] for each i that has so many."""
    n = len(x)
    if n < width:
        return x[:0]
    blocks = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def range_hashes(w: Words, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the words begin[i]:end[i], for ranges of any lengths."""
    h = mixed(w.hash + np.uint64(seed * _STEP & (1 << 64) - 1))
    pw, inv = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * pw[: len(h)], out=total[1:])
    return mixed((total[end] - total[begin]) * inv[begin] + (end - begin).astype(np.uint64))


@dataclass
class Anchors:
    """Runs of neighbouring windows that have the same smallest gram: its hash, first window, windows."""

    value: np.ndarray
    begin: np.ndarray
    count: np.ndarray


def anchors(w: Words, window: int, gram: int) -> Anchors:
    """The windows of ``window`` words of each text, by the smallest of their grams' hashes.

    Equal windows have equal smallest grams, wherever they stand. About every (window - gram) / 2 words
    a new one begins.
    """
    g, _ = grams(w, gram)
    low = sliding_min(g, window - gram + 1)
    ok = w.left()[: len(low)] >= window
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (low[1:] != low[:-1])
    last = ok.copy()
    last[:-1] &= ~ok[1:] | (low[1:] != low[:-1])
    begin = np.flatnonzero(new)
    return Anchors(low[begin], begin, np.flatnonzero(last) + 1 - begin)
