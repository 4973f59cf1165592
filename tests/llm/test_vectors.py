"""Operator 12 against all pairs."""

import random

import numpy as np
import pytest

from revisit_spark.llm.vectors import linked, near_vectors, spherical_kmeans

SCHEMA = "vec_id long, embedding array<double>, label string, n_links string, component_id string, cls string, w string, path string"
NAN, INF = float("nan"), float("inf")


def brute(rows, cosine=0.98):
    ok = [r for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    unit = [np.array(r[1]) / np.abs(r[1]).max() for r in ok]
    unit = [x / np.linalg.norm(x) for x in unit]
    n, root = [0] * len(ok), list(range(len(ok)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ok)):
        for j in range(i):
            if ok[i][2] == ok[j][2] and len(ok[i][1]) == len(ok[j][1]) and unit[i] @ unit[j] >= cosine:
                n[i] += 1
                n[j] += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, r in enumerate(ok):
        least.setdefault(top(i), []).append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    out = [(r[0], n[i], least[top(i)], r[0] == least[top(i)]) for i, r in enumerate(ok)]
    out += [(r[0], 0, r[0], True) for r in rows if not any(r is x for x in ok)]
    return sorted(out, key=str)


def rows(n, dims=6, spread=0.08, seed=1):
    made, r = random.Random(seed), np.random.default_rng(seed)
    centres = r.normal(size=(30, dims))
    out = []
    for i in range(n):
        c = centres[made.randrange(30)]
        v = (c / np.linalg.norm(c) + r.normal(size=dims) * spread * made.choice([0.1, 1, 3])) * made.choice([1, 2, 0.001])
        out.append((made.choice([i, i, i // 2, None]) if i % 50 == 0 else 1000 + i, v.tolist(), made.choice(["a", "a", "a", "b", None])))
    out += [(5000 + i, out[7][1], out[7][2]) for i in range(40)]
    out += [(1, None, "a"), (2, [], "a"), (3, [0.0] * dims, "a"), (4, [1.0, None, *[0.0] * (dims - 2)], "a"), (5, [NAN] * dims, "a"), (6, [INF] * dims, "a"), (7, [1e300] * dims, "b"), (8, [1e-300] * dims, "b"), (8, [1e-300] * dims, "b"), (9, [1.0], "b"), (10, [5.0], "b"), (None, [-1.0], "b"), (11, [0.0, -0.0, 1.0], "b"), (12, [0.0, 0.0, 1.0], "b")]
    return out


@pytest.mark.parametrize(("cell", "block", "spread"), [(1024, 2048, 0.08), (60, 50, 0.08), (40, 30, 0.02), (30, 16, 0.3)])
def test_all_pairs(spark, cell, block, spread):
    made = rows(700, spread=spread)
    d = spark.createDataFrame([(*r, *["c"] * 5) for r in made], SCHEMA).repartition(3)
    got = near_vectors(d, cell=cell, block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(made)


def test_splits_are_made(spark):
    """With clear clusters cells are split, twice over, and vectors beside a border visit."""
    from pyspark.sql import functions as F

    from revisit_spark.llm.vectors import cells

    made = np.random.default_rng(4).normal(size=(3000, 3))
    made /= np.linalg.norm(made, axis=1)[:, None]
    d = spark.createDataFrame([("a", "3", i, 1, bytearray(x.tobytes())) for i, x in enumerate(made)], "lab string, path string, cls long, w long, u binary")
    got = cells(d, 0.999, 20)
    r = got.agg(F.count_distinct("path").alias("n"), F.max(F.length(F.regexp_replace("path", "[^.]", ""))).alias("deep"), F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("visits")).first()
    assert r.n > 64 and r.deep >= 2 and r.homes == 3000 and r.visits > 0


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_strips_and_centres():
    made = np.random.default_rng(3)
    u = made.normal(size=(1300, 3))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w, home, every = np.ones(1300, np.int64), np.ones(1300, bool), np.arange(1300)
    n, root = linked(u, w, home, every, every, 0.999)
    near = (u @ u.T >= 0.999) & ~np.eye(1300, dtype=bool)
    assert (n == near.sum(axis=1)).all()
    assert all(root[i] == root[j] for i, j in zip(*np.nonzero(near), strict=True))
    c = spherical_kmeans(u, 8)
    assert c.shape == (8, 3) and np.allclose((c**2).sum(axis=1), 1)
    assert len(spherical_kmeans(np.ones((5, 1)), 3)) == 1


def near_copies(n, dims=64, seed=9):
    """Vectors in all directions, every fourth one beside the one before it."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dims))
    x[::4] = x[1::4][: len(x[::4])] + 0.03 * r.normal(size=x[::4].shape)
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_signatures_miss_no_link():
    from revisit_spark.llm.vectors import LOST, signatures

    for dims in (3, 20, 64, 200):
        u = near_copies(400, dims)
        s = signatures(u).astype(np.float32)
        assert (s @ s.T >= u @ u.T - LOST).all()
        d = lambda x: np.sqrt(np.maximum(0, ((x[:, None] - x[None]) ** 2).sum(axis=2)))
        assert (d(s.astype(np.float64)) <= d(u) + LOST).all()


def test_vectors_of_no_link_stay_where_they_are(spark, monkeypatch):
    """Few of the bytes of vectors without clusters are written again: only those that signatures link are compared by all they have."""
    from revisit_spark.llm import vectors

    put = {}

    def saved(df, name="t"):
        put.setdefault(name, []).append(kept := df.localCheckpoint())
        return kept

    monkeypatch.setattr(vectors, "saved", saved)
    u = near_copies(3000)
    d = spark.createDataFrame([(i, x.tolist(), "a") for i, x in enumerate(u)], "vec_id long, embedding array<float>, label string")
    near = (u @ u.T >= 0.98) & ~np.eye(len(u), dtype=bool)
    got = {r.vec_id: r.n_links for r in near_vectors(d).collect()}
    assert [got[i] for i in range(len(u))] == near.sum(axis=1).tolist() and near.sum() == 1500
    assert put["units"][0].count() == 1500 and "cells" not in put and "whole" not in put
