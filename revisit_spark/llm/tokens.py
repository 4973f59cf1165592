"""Operator 1: token ids, packed into rows of equal length and written as binary columns.

Each partition turns its texts into ids of a public byte-level vocabulary and packs them block by
block: a text longer than a row is cut into whole rows and a rest, nothing is dropped; rests and
short texts are placed longest first, each into the open row with the least room that still holds it
(best-fit decreasing). Open rows are kept by their room; a segment tree over the rooms 0 to row length
finds the least room that is enough in log(row length) steps.

There is no shuffle. Blocks bound the memory, and a block of some million ids leaves almost no
padding. A row's content depends on how Spark cut the input, what the rows hold in all does not.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow
from .words import pieces, ragged

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
ROW, BLOCK = 2048, 2_000_000
#: Fixed value: the vocabulary's published pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the characters that the pattern's \\s stands for.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space from this length on are encoded as one piece, and longer texts in parts of that size.
LONG_RUN, PART = 256, 1 << 20
_long_run = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")
_cut = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
_made: dict[tuple, Encoder] = {}


class Encoder:
    """A vocabulary's ids of texts, in the smallest type that holds them and ``end``."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN, end: int | None = None):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("packed", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.end = max(table.values()) + 1 if end is None else end
        self.dtype = np.dtype("<u2" if max(*table.values(), self.end) <= 0xFFFF else "<u4")
        self.known = pattern == PATTERN

    @staticmethod
    def of(ranks: bytes, pattern: str = PATTERN, end: int | None = None) -> Encoder:
        """The one of this process."""
        key = hashlib.sha256(ranks + pattern.encode()).hexdigest(), end
        if key not in _made:
            _made.clear()
            _made[key] = Encoder(ranks, pattern, end)
        return _made[key]

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text, the same as of encoding it at once.

        Under the fixed pattern a run of white space begins a token, and but for its last character (all of
        it at the text's end) is a token's whole input; so long runs are encoded alone, as the pattern's
        look-ahead would need a stack as deep as the run, and long texts are cut where such runs begin.
        """
        if not self.known or len(text) < LONG_RUN:
            return self._plain(text)
        out, at = [], 0
        for run in _long_run.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += self._parts(text, at, run.start())
            out.append(np.array(self.encoding._encode_single_piece(text[run.start() : end]), np.uint32))
            at = end
        out += self._parts(text, at, len(text))
        return np.concatenate(out).astype(self.dtype)

    def _parts(self, text: str, at: int, until: int) -> Iterator[np.ndarray]:
        while at < until:
            found = _cut.search(text, at + PART, until) if until - at > PART else None
            to = found.start() if found else until
            yield self._plain(text[at:to])
            at = to

    def _plain(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), np.uint32).astype(self.dtype)

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        return [self.ids(t or "") for t in texts]


class RoomTree:
    """Which rooms 0..most are on offer; finds the least one that is at least so large."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, room: int, there: bool) -> None:
        node = self.leaves + room
        self.any[node] = there
        while node > 1:
            node >>= 1
            now = self.any[2 * node] | self.any[2 * node + 1]
            if self.any[node] == now:
                break
            self.any[node] = now

    def least(self, room: int) -> int | None:
        node = self.leaves + room
        if self.any[node]:
            return room
        while node > 1:
            if not node & 1 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_decreasing(lengths: list[int], row: int) -> list[list[int]]:
    """Rows as lists of the places of their segments; lengths are 1 to ``row``. Ties go by place."""
    tree, by_room, out = RoomTree(row), [[] for _ in range(row + 1)], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.least(lengths[i])
        if room is None:
            room, at = row, len(out)
            out.append([])
        else:
            at = by_room[room].pop()
            if not by_room[room]:
                tree.set(room, False)
        out[at].append(i)
        left = room - lengths[i]
        by_room[left].append(at)
        if len(by_room[left]) == 1:
            tree.set(left, True)
    return out


def _pack(ids: list[np.ndarray], docs: pa.Array, row: int, dtype: np.dtype, pad: int) -> pa.RecordBatch:
    segments = [(d, a, min(len(x) - a, row)) for d, x in enumerate(ids) for a in range(0, len(x), row)]
    rows = best_fit_decreasing([n for _, _, n in segments], row)
    matrix = np.full((len(rows), row), pad, dtype)
    ends, owner, starts, edge, at_segment = [], [], [], [0], [0]
    for r, places in enumerate(rows):
        at = 0
        ends.append(0)
        for s in places:
            d, a, n = segments[s]
            matrix[r, at : at + n] = ids[d][a : a + n]
            at += n
            ends.append(at)
            owner.append(d)
            starts.append(a)
        edge.append(len(ends))
        at_segment.append(len(owner))
    cumulative, bounds = np.array(ends, np.int64), np.array(edge)
    last = np.zeros(len(cumulative), bool)
    last[bounds[1:] - 1] = True
    raw = matrix.tobytes()
    size = row * dtype.itemsize
    return pa.RecordBatch.from_arrays(
        [
            pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary()),
            pa.array(cumulative[bounds[1:] - 1], pa.int32()),
            ragged(cumulative, bounds, pa.int32()),
            ragged(cumulative[~last], np.array(at_segment), pa.int32()),
            pa.ListArray.from_arrays(pa.array(at_segment, pa.int32()), docs.take(pa.array(owner, pa.int64()))),
            ragged(np.array(starts, np.int64), np.array(at_segment), pa.int64()),
        ],
        names=["input_ids", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "doc_starts"],
    )


def packed_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, row: int = ROW, block: int = BLOCK, end: int | None = None, mark_ends: bool = True, pattern: str = PATTERN, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows of ``row`` token ids. Columns:

    input_ids (binary): ``row`` little-endian unsigned ids, of 2 bytes if the vocabulary allows, else 4;
    the rest after n_tokens is padding (``end``). cu_seqlens: 0 and the end of each
    segment. position_resets: where positions start at 0 again, each segment's first place. doc_ids:
    the document of each segment. doc_starts: the segment's first token within its document, so
    that a document cut over rows can be joined again. ``end`` (by default the id after the vocabulary's largest) follows each document's
    last token, unless ``mark_ends`` is false.

    Null and empty texts have no tokens and are in no row, an empty table has no rows. A null id is kept as
    null; repeated rows are packed once each. Texts are taken whole, whatever their length and characters. ``vocabulary`` is a file on the driver, of fixed size, that
    is sent to the tasks. Other columns are not read.
    """
    if row < 1 or block < 1:
        raise ValueError("row and block must be positive")
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(ranks.value, pattern, end)
        ids, owners, held = [], [], 0
        tail = np.array([encoder.end] * mark_ends, encoder.dtype)
        for batch in pieces(batches, "_text", 1 << 20):
            got = encoder.batch(batch.column("_text").to_pylist())
            some = np.array([len(x) > 0 for x in got])
            ids += [np.concatenate([x, tail]) for x in got if len(x)]
            owners.append(batch.column("_id").filter(pa.array(some, pa.bool_())))
            held += sum(map(len, got))
            if held >= block:
                yield _pack(ids, pa.concat_arrays(owners), row, encoder.dtype, encoder.end)
                ids, owners, held = [], [], 0
        if ids:
            yield _pack(ids, pa.concat_arrays(owners), row, encoder.dtype, encoder.end)

    rows = docs.select(docs[id_col].alias("_id"), docs[text].cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return in_arrow(rows, run, f"input_ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{kind}>, doc_starts array<long>")


def segments(packed: DataFrame, size: int = 2) -> DataFrame:
    """(doc_id, start, ids): the segments of packed rows, ids of ``size`` bytes each."""
    each = packed.select("input_ids", "cu_seqlens", "doc_ids", "doc_starts", F.posexplode(F.slice("cu_seqlens", 1, F.size("cu_seqlens") - 1)).alias("i", "from"))
    until = F.element_at("cu_seqlens", F.col("i") + 2)
    return each.select(F.element_at("doc_ids", F.col("i") + 1).alias("doc_id"), F.element_at("doc_starts", F.col("i") + 1).alias("start"), F.expr("input_ids").substr(F.col("from") * size + 1, (until - F.col("from")) * size).alias("ids"))
