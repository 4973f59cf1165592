"""Operator 12: near-duplicates of embeddings, by spherical k-means cells and blocked cosine products.

Vectors are compared with those of their own label (and length). Equal ones are one class from the start.

All pairs are first judged by signatures of some 50 bytes: a unit vector's share in WIDTH fixed directions that are
orthogonal, and the length of the rest. Signatures of two vectors have at least their cosine (Cauchy-Schwarz on
the rest), so no link is missed; only the groups that signatures link, mostly small ones, are
compared by the vectors themselves, which are what counts. Both comparisons are made as follows.

Cells: spherical k-means, fitted to a bounded sample of each cell, splits cells of more than CELL
classes, again and again. A vector's home is the cell of its nearest centre. Two unit vectors of cosine c lie
within d = sqrt(2 - 2c) of each other, so one that has a link in another cell lies within d of the plane
between the two centres; it visits that cell as well. Of two cells only the one with the larger number sends
visitors to the other, so each pair meets once, and no link is lost at a border. A split that saves less
than half of a cell's comparisons (vectors without clusters, or all within d), or that makes more than VISITS rows of one, is
not made; where a cell's sample says so, its rows aren't dealt for it.

Products: a cell's vectors are dealt into few blocks (a vector is sent to each pair that its block is in, so to as many
tasks as there are blocks), of a bounded size in bytes, every two blocks meet in one task, which
multiplies them in strips. What leaves the task is, for each vector, how many it is linked with and
the smallest vector that it is connected with there: rows as many as vectors, not as pairs. Components of
those stars are the groups; of each group the smallest id is kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, in_arrow, saved
from .components import components

COSINE = 0.98
#: Classes of a cell that is split no further; centres of one split; sample that they are fitted to, and rounds.
CELL, CENTRES, SAMPLE, ROUNDS = 1024, 64, 8192, 8
#: Vectors of a block at least, blocks of a cell unless these would have more bytes; rows and columns of a strip of products; splits of splits at most.
BLOCK, BLOCKS, BYTES, STRIP, TILE, DEPTH = 2048, 6, 16 << 20, 512, 4096, 8
#: Rows that a split may make of one on average: beyond that, blocks send a vector to fewer places.
VISITS = 2
#: Pairs that are joined into groups at a time.
HELD = 1 << 20
#: For what rounding may add to a distance from a plane.
SLACK = 1e-9
#: Directions of a signature; what halves in place of doubles may change of a cosine or a distance (2 x 2^-11, and products of floats).
WIDTH, LOST = 24, 1e-3
_ROW = "lab string, path string, home boolean, cls long, w long, u binary"


def _usable(lab: Column, v: Column) -> Column:
    """Whether a vector can be linked at all: a label, components that are finite numbers, not all of them 0."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return lab.isNotNull() & v.isNotNull() & ~F.exists(v, odd) & F.exists(v, lambda x: x != 0)


def _same_length(v: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the vectors of each length, and these vectors as rows of doubles; null and empty ones have none."""
    n = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat, start = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(n) - n
    for d in np.unique(n[n > 0]):
        at = np.flatnonzero(n == d)
        yield at, flat[start[at][:, None] + np.arange(d)].astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is taken out first, so nothing overflows."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


@cache
def _directions(d: int) -> np.ndarray:
    """Orthogonal directions of length 1, the same in every task."""
    return np.linalg.qr(np.random.default_rng(d).normal(size=(d, min(d, WIDTH))))[0]


def signatures(u: np.ndarray) -> np.ndarray:
    """For rows of length 1, rows of length 1 in halves; their cosines are no smaller, but for LOST."""
    p = u @ _directions(u.shape[1])
    return np.hstack([p, np.sqrt(np.maximum(0, 1 - (p * p).sum(axis=1)))[:, None]]).astype(np.float16)


def _keyed(rows: DataFrame, element: str) -> DataFrame:
    """Vectors with 16 bytes that stand for each (``key``) and its signature (``u``), null where there is no vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, made = [None] * batch.num_rows, [None] * batch.num_rows
            for at, x in _same_length(batch.column("v")):
                for i, whole, sign in zip(at, x + 0.0, signatures(_unit(x)), strict=True):  # -0.0 + 0.0 is 0.0
                    keys[i], made[i] = hashlib.blake2b(whole.tobytes(), digest_size=16).digest(), sign.tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "lab", "path", "v")), pa.array(keys, pa.binary()), pa.array(made, pa.binary())], names=["row", "id", "lab", "path", "v", "key", "u"])

    id_type = rows.schema["id"].dataType.simpleString()
    return in_arrow(rows.select("row", "id", "lab", "path", "v"), run, f"row long, id {id_type}, lab string, path string, v array<{element}>, key binary, u binary")


def _units(classes: DataFrame) -> DataFrame:
    """Vectors ``v`` as bytes of doubles ``u`` of length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None] * batch.num_rows
            for at, x in _same_length(batch.column("v")):
                for i, u in zip(at, _unit(x), strict=True):
                    made[i] = u.tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lab", "path", "cls", "w")), pa.array(made, pa.binary())], names=["lab", "path", "cls", "w", "u"])

    return in_arrow(classes.select("lab", "path", "cls", "w", "v"), run, "lab string, path string, cls long, w long, u binary")


def _matrix(u: pd.Series, kind: type = np.float64) -> np.ndarray:
    """Rows of numbers of ``kind``; halves as floats."""
    x = np.frombuffer(b"".join(u), kind).reshape(len(u), -1)
    return x if kind is np.float64 else x.astype(np.float32)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 12) -> np.ndarray:
    """``k`` centres of length 1 (fewer if there are fewer different rows) of rows of length 1."""
    made = np.random.default_rng(seed)
    chosen = [int(made.integers(len(x)))]
    far = 1 - x @ x[chosen[0]]
    while len(chosen) < k and (far := np.maximum(far, 0)).sum() > 1e-9:
        chosen.append(int(np.searchsorted(np.cumsum(far), made.random() * far.sum()).clip(0, len(x) - 1)))
        far = np.minimum(far, 1 - x @ x[chosen[-1]])
    centres = x[chosen].copy()
    for _ in range(rounds):
        at = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        length = np.sqrt((sums**2).sum(axis=1))
        moved = length > 1e-9  # an empty cell, or one whose members cancel out, keeps its centre
        centres[moved] = sums[moved] / length[moved, None]
    return centres


def _near(x: np.ndarray, at_home: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of these rows is in the cell of each centre, at home or as a visitor; and the cell of its nearest centre."""
    dots = x @ c.T
    best = dots.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
    near = dots[np.arange(len(x)), best][:, None] - dots <= reach * apart[best] + SLACK
    near &= ~at_home[:, None] | (np.arange(len(c)) < best[:, None])
    near[np.arange(len(x)), best] = True
    return near, best


def _centres(rows: DataFrame, cell: int, reach: float, kind: type) -> DataFrame:
    """(lab, path, centres, salts): of each of these cells where its sample says that a split pays; ``n`` is its number of classes."""

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cls")
        k = int(min(CENTRES, max(2, math.ceil(2 * part["n"].iloc[0] / cell))))
        x = _matrix(part["u"], kind).astype(np.float64)
        c = spherical_kmeans(x, k)
        near, best = _near(x, np.ones(len(x), bool), c, reach)
        h = np.bincount(best, minlength=len(c)).astype(np.float64)
        pays = float(h @ (near.sum(axis=0) - h / 2)) <= 0.5 * len(x) * len(x) / 2 and near.sum() <= VISITS * len(x)
        return pd.DataFrame({"lab": part["lab"].iloc[:1], "path": part["path"].iloc[:1], "centres": [c.tobytes()], "salts": [math.ceil(part["n"].iloc[0] / SAMPLE)]})[: int(pays)]

    spot = F.shiftrightunsigned(F.xxhash64("cls"), 11) / float(1 << 53)
    few = rows.where(F.col("home") & (spot < SAMPLE / F.col("homes"))).select("lab", "path", "n", "cls", "u")
    return few.groupBy("lab", "path").applyInPandas(fit, "lab string, path string, centres binary, salts long")


def _dealt(rows: DataFrame, centres: DataFrame, reach: float, kind: type) -> DataFrame:
    """Rows in the cells within their cells, at home or as visitors: (parent, and the columns of a row)."""

    def assign(part: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame(columns=["parent", "lab", "path", "home", "cls", "w", "u"])
        x = _matrix(part["u"], kind).astype(np.float64)
        c = np.frombuffer(of["centres"].iloc[0], np.float64).reshape(-1, x.shape[1])
        at_home = part["home"].to_numpy(bool)
        near, best = _near(x, at_home, c, reach)
        i, j = np.nonzero(near)
        out = part[["lab", "path", "cls", "w", "u"]].iloc[i].reset_index(drop=True)
        out["parent"] = out["path"]
        out["path"] = out["path"] + "." + pd.Series(j).astype(str)
        out["home"] = at_home[i] & (j == best[i])
        return out[["parent", "lab", "path", "home", "cls", "w", "u"]]

    salted = rows.join(centres.select("lab", "path", "salts"), ["lab", "path"]).withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts"))).drop("salts")
    each = centres.select("lab", "path", "centres", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    by = ["lab", "path", "salt"]
    return salted.groupBy(*by).cogroup(each.groupBy(*by)).applyInPandas(assign, f"parent string, {_ROW}")


def _cost(h: str, v: str) -> Column:
    return F.col(h).cast("double") * F.col(h) / 2 + F.col(h).cast("double") * F.col(v)


def cells(units: DataFrame, cosine: float = COSINE, cell: int = CELL, kind: type = np.float64, lost: float = 0.0) -> DataFrame:
    """``units``, numbers of ``kind``, in cells (lab, path) of at most about ``cell`` where splits are worth it; a row for each visit.

    ``lost`` is what rounding may have added to the distance of two of them.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + lost + SLACK
    rows = units.withColumn("home", F.lit(True)).select("lab", "path", "home", "cls", "w", "u")
    done = []
    for _ in range(DEPTH):
        sizes = rows.groupBy("lab", "path").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("visits"))
        large = saved(sizes.withColumn("n", F.col("homes") + F.col("visits")).where((F.col("n") > cell) & (F.col("homes") > 1)), "large")
        if not large.head(1):
            break
        centres = saved(_centres(rows.join(large, ["lab", "path"]), cell, reach, kind), "centres")
        if not centres.head(1):
            break
        dealt = saved(_dealt(rows, centres, reach, kind), "cells")
        parts = dealt.groupBy("lab", "parent", "path").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("v"))
        after = parts.groupBy("lab", F.col("parent").alias("path")).agg(F.sum(_cost("h", "v")).alias("after"))
        split = saved(large.join(after, ["lab", "path"]).where(F.col("after") <= 0.5 * _cost("homes", "visits")).select("lab", "path"), "split")
        done.append(rows.join(split, ["lab", "path"], "left_anti"))
        rows = dealt.join(split.withColumnRenamed("path", "parent"), ["lab", "parent"], "left_semi").drop("parent")
    if not done:
        return rows  # as they have been written
    done.append(rows)
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return saved(whole, "whole")


def _hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of a[i] and b[i], for all i; ``root`` has each one's smallest member."""
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root[:] = up


def linked(u: np.ndarray, w: np.ndarray, home: np.ndarray, first: np.ndarray, second: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """For each of some vectors: weights of those linked with it, and the smallest place connected with it.

    ``first`` are compared with ``second`` (places), or the vectors of one block among themselves where both are
    the same; two visitors aren't compared.
    """
    n, root = np.zeros(len(u), np.int64), np.arange(len(u))
    same, right = first is second, u[second]
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> None:
        if held:
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            np.add.at(n, a, w[b])
            np.add.at(n, b, w[a])
            _hook(root, a, b)
            held.clear()

    for s in range(0, len(first), STRIP):
        rows = first[s : s + STRIP]
        left = u[rows]
        for t in range(s - s % TILE if same else 0, len(second), TILE):
            i, j = np.nonzero(left @ right[t : t + TILE].T >= cosine)
            a, b = rows[i], second[t : t + TILE][j]
            kept = (home[a] | home[b]) & ((a < b) if same else True)
            held.append((a[kept], b[kept]))
            if sum(len(x) for x, _ in held) >= HELD:
                settle()
    settle()
    return n, root


def _compared(whole: DataFrame, cosine: float, block: int, kind: type = np.float64) -> DataFrame:
    """(cls, low, n): the links that a class has in one task, and the smallest class connected with it there."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cls", kind="stable")
        cls, side = part["cls"].to_numpy(), part["side"].to_numpy()
        first = np.flatnonzero(side == key[2])
        second = first if key[2] == key[3] else np.flatnonzero(side == key[3])
        n, root = linked(_matrix(part["u"], kind), part["w"].to_numpy(), part["home"].to_numpy(bool), first, second, cosine)
        hit = n > 0
        return pd.DataFrame({"cls": cls[hit], "low": cls[root[hit]], "n": n[hit]})

    fit = F.least(F.greatest(F.count("*") / BLOCKS, F.lit(block)), BYTES / (F.max(F.octet_length("u")) + 100))  # 100 bytes: a row's other columns
    sizes = whole.groupBy("lab", "path").agg(F.ceil(F.count("*") / fit).alias("blocks"), F.count_if("home").alias("homes"))
    sided = whole.join(sizes.where("homes > 0"), ["lab", "path"]).withColumn("side", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    met = sided.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("lab", "path", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "home", "cls", "w", "u")
    return met.groupBy("lab", "path", "i", "j").applyInPandas(run, "cls long, low long, n long")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """Per row: its id, n_links (others linked directly), component_id (smallest id reachable, its own included), kept.

    Vectors without a label, null, empty or zero ones, and those with a null or non-finite component are
    linked with nothing; so are vectors of different lengths. Copies are linked with each other. A null
    id is no smallest one: a group of null ids alone has a null component and is kept. Rows that repeat an id are
    vectors of their own. An empty table has no rows; other columns are not read.
    """
    element = "float" if rows.schema[vector].dataType.simpleString() == "array<float>" else "double"
    v, lab = rows[vector].cast(f"array<{element}>"), rows[label].cast("string")
    plain = rows.select(F.monotonically_increasing_id().alias("row"), rows[id_col].alias("id"), lab.alias("lab"), F.when(_usable(lab, v), v).alias("v"))
    every = saved(_keyed(plain.withColumn("path", F.size("v").cast("string")), element), "vectors")
    same = ["lab", "path", "key"]
    classes = saved(every.where("key is not null").groupBy(*same).agg(F.min("row").alias("cls"), F.count("*").alias("w"), F.min("id").alias("least"), F.first("u").alias("u")), "classes")
    member = saved(every.select("id", *same).join(classes.select(*same, "cls"), same, "left").select("id", "cls"), "members")
    signs = cells(classes.select("lab", "path", "cls", "w", "u"), cosine, cell, np.float16, LOST)
    maybe = components(_compared(signs, cosine - LOST, block, np.float16).select(F.col("cls").alias("a"), F.col("low").alias("b")))
    few = saved(classes.select("lab", "path", "cls", "w").join(maybe.withColumnRenamed("id", "cls"), "cls"), "few")
    # Groups of signatures go into cells of half of ``cell`` on average; one that is larger is split there like any cell.
    bins = few.groupBy("lab", "path").agg(F.ceil(2 * F.count("*") / cell).alias("bins"))
    binned = few.join(bins, ["lab", "path"]).withColumn("path", F.concat_ws(".", "path", F.pmod(F.xxhash64("component"), "bins").cast("string")))
    units = saved(_units(binned.join(every.select(F.col("row").alias("cls"), "v"), "cls")), "units")
    forget(every, few)
    found = saved(_compared(cells(units, cosine, cell), cosine, block), "compared")
    groups = components(found.select(F.col("cls").alias("a"), F.col("low").alias("b")))
    grouped = classes.select("cls", "w", "least").join(groups.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    grouped = grouped.join(found.groupBy("cls").agg(F.sum("n").alias("n")), "cls", "left")
    lowest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    known = grouped.join(lowest, "component").select("cls", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id", F.lit(True).alias("linkable"))
    out = member.join(known, "cls", "left")
    component = F.when(F.col("linkable"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
