"""A set of hashes as a bitmap of bounded size: small enough to send to every task, whatever the data.

A hash that is in the set always tests true; others do so with the bitmap's share of set bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, in_arrow

#: 2**25 bits are 4 MB.
BITS = 25


#: Bitmaps that are sized by what they hold take 4 MB to 32 MB.
FEWEST, MOST = 25, 28


def bits_for(items: int) -> int:
    """Bits of a bitmap for so many items: eight for each, as long as it stays small enough to send.

    A fuller bitmap lets more through to the exact step behind it; results don't depend on it.
    """
    return min(MOST, max(FEWEST, (8 * max(items, 1) - 1).bit_length()))


def cell(h: Column, bits: int = BITS) -> Column:
    return h.bitwiseAND(F.lit((1 << bits) - 1))


def bitmap(cells: DataFrame, bits: int = BITS) -> np.ndarray:
    """Packed bits of the cells in the only column of ``cells`` (0 to 2**bits - 1; null is left out).

    Spark sets the bits, in slices of 4 KB; the driver gets 2**bits / 8 bytes at most.
    """
    x = F.col(cells.columns[0]) + 1
    slices = cells.where(x.isNotNull()).groupBy(F.bitmap_bucket_number(x).alias("slice")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits"))
    out = np.zeros(1 << bits - 3, np.uint8)
    for row in slices.toLocalIterator():
        at = (row["slice"] - 1) * 4096
        part = np.frombuffer(bytes(row["bits"]), np.uint8)[: len(out) - at]
        out[at : at + len(part)] = part
    return out


def member(packed: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) may be in the set."""
    at = h & np.uint64(len(packed) * 8 - 1)
    return (packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def spot(*columns: str, bits: int = BITS) -> Column:
    """The cell of a row's values in these columns."""
    return cell(F.xxhash64(*columns), bits)


def possible(rows: DataFrame, packed, spots: str, there: bool = True) -> DataFrame:
    """Rows whose cell (column ``spots``) is in the broadcast bitmap; with ``there`` false, the others.

    Ahead of a join with the keys that the bitmap was made of, it keeps most other rows from being shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                yield batch.filter(pa.array(member(packed.value, batch.column(spots).to_numpy().view(np.uint64)) == there))

    return in_arrow(rows, run, rows.schema)


def without(rows: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """``rows`` but for those whose ``key`` is in the only column of ``gone`` (distinct, not null).

    Only rows whose cell is in a bitmap of ``gone`` are shuffled for the anti-join; the others pass as they are.
    """
    k, s = free_name(rows, "_key"), free_name(rows, "_cell")
    name = gone.columns[0]
    bits = bits_for(gone.count())
    sent = rows.sparkSession.sparkContext.broadcast(bitmap(gone.select(spot(name, bits=bits)), bits))
    keyed = rows.withColumn(k, key)
    keyed = keyed.withColumn(s, F.coalesce(spot(k, bits=bits), F.lit(0)))
    near = possible(keyed, sent, s).join(gone.select(F.col(name).alias(k)), k, "left_anti").select(*rows.columns)
    return possible(keyed, sent, s, False).select(*rows.columns).union(near)
