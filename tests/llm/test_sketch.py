"""The merged sketch against plain counts."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from revisit_spark.llm.bitmap import member
from revisit_spark.llm.sketch import PART, PART_BYTES, pack, repeated_cells, unpack


@pytest.mark.parametrize("share", [0, 1e-4, 0.01, 0.05, 0.0624, 0.0626, 0.5, 1])
def test_parts_return_as_they_were(share):
    part = np.packbits(np.random.default_rng(3).random(1 << PART) < share, bitorder="little")
    assert (unpack(pack(part)) == part).all() and len(pack(part)) <= PART_BYTES
    ends = np.zeros(PART_BYTES, np.uint8)
    ends[[0, -1]] = 1, 128
    assert pack(ends) == np.array([0, (1 << PART) - 1], "<u2").tobytes() and (unpack(pack(ends)) == ends).all()


@pytest.mark.parametrize("rows", [0, 1, 3000, 400_000])
def test_cells_hit_twice(spark, rows):
    bits = 18

    def cells_of(batches):
        for batch in batches:
            yield (batch.column("id").to_numpy() * 7919 % 300_007 & (1 << bits) - 1).astype(np.uint64)
            yield np.zeros(0, np.uint64)

    got = repeated_cells(spark.range(0, rows, 1, 5), cells_of, bits)
    count = Counter(i * 7919 % 300_007 & (1 << bits) - 1 for i in range(rows))
    assert len(got) == 1 << bits - 3
    found = np.flatnonzero(member(got, np.arange(1 << bits, dtype=np.uint64))).tolist()
    assert found == sorted(c for c, n in count.items() if n > 1)


def test_one_cell_in_many_tasks(spark):
    def cells_of(batches):
        yield from (np.full(b.num_rows, 5, np.uint64) for b in batches)

    assert repeated_cells(spark.range(0, 1, 1, 4), cells_of, 4).sum() == 0
    got = repeated_cells(spark.range(0, 40, 1, 40), cells_of, 4)
    assert got[0] == 32 and got.sum() == 32 and isinstance(pa.array(got), pa.UInt8Array)
