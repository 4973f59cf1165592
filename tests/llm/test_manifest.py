"""Operator 11 against a plain Merkle tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from revisit_spark.llm import queries
from revisit_spark.llm.manifest import manifest, proof_digest, verified

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, leaf string, `rank` string, `_at` string"


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf_of(r, more=0):
    return h(*(field(x) for x in (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))


def climb(digests, arity):
    """Root of a list of digests, and each one's siblings by level, on the left and on the right."""
    at, paths = list(range(len(digests))), [[] for _ in digests]
    while len(digests) > 1:
        runs = [digests[i : i + arity] for i in range(0, len(digests), arity)]
        for k, i in enumerate(at):
            run, j = runs[i // arity], i % arity
            paths[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
        at, digests = [i // arity for i in at], [h(*run) for run in runs]
    return digests[0], paths


def brute(rows, arity=2):
    langs, out = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode())), []
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = own, *climb([leaf_of(r) for r in own], arity)
    root, above = climb([trees[x][1] for x in langs], arity)
    for lang, up in zip(langs, above, strict=True):
        own, subroot, paths = trees[lang]
        for r, path in zip(own, paths, strict=True):
            path = path + up
            x = leaf_of(r, 1 if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else 0)
            for a, b in path:
                x = h(a, x, b)
            out.append((r[0], leaf_of(r), subroot, root, h(*(a + b for a, b in path)), x, x == root))
    return sorted(out, key=str)


def rows(n):
    langs = ["en"] * 6 + ["fr", "de", None, "", "é"]
    made = [(None if i % 23 == 0 else i // 2, None if i % 19 == 0 else f"tëxt {i // 2}" * (i % 5), langs[i % 11], None if i % 3 else "s", None if i % 4 == 0 else i, *["c"] * 4) for i in range(n)]
    return [*made, *made[:5], (7, "x" * 300_000, "lone", "s", (1 << 63) - 1, *["c"] * 4)]


@pytest.mark.parametrize(("arity", "height"), [(2, 10), (2, 2), (3, 1), (5, 2)])
def test_plain_tree(spark, arity, height):
    made = rows(230)
    docs = spark.createDataFrame(made, SCHEMA).repartition(3)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    tampered = {"n_chars": F.when(crc % 7 == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))}
    found = verified(manifest(docs, presented=tampered, arity=arity, height=height))
    got = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")), "folded_root", "verified")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(made, arity)


def test_query(spark, tmp_path):
    for name, made in (("many", rows(2100)), ("one", rows(0)), ("none", [])):
        spark.createDataFrame(made, SCHEMA).write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        got = queries.op11_manifest(spark, f"file://{tmp_path}/{name}").collect()
        assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got), key=str) == (brute(made) if made else [])
