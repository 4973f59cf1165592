"""Operator 13 against a plain count."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from revisit_spark.llm import queries
from revisit_spark.llm.importance import counted, resampled, splitter, stretches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, row string, weight string, `group` string, score string"


def features(text, ngram):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(w[i : i + k]) for k in range(1, ngram + 1) for i in range(len(w) - k + 1)], len(w)


def brute(docs, target, ngram=1):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    each = [(i, *features(t, ngram)) for i, t in docs]
    s, t = Counter(bucket(f) for _, x, _ in each for f in x), Counter(bucket(f) for x in target for f in features(x, ngram)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = []
    for i, x, n in each:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in x)
        out.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 10 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def made(n):
    r = random.Random(7)
    words = ["the", "Stone", "RIVER", "élan", "ÉTÉ", "x1", "é1", "中文", "a_b", "don't", "…", "́", "\x7f", "ß", "😀"]
    rows = [(i if i % 17 else i // 3, "".join(r.choice(words) + r.choice([" ", "  ", "\n", ", ", "-"]) for _ in range(r.choice([0, 3, 19, 20, 60])))) for i in range(n)]
    return [*rows, *rows[:3], (None, "river " * 30), (None, "river " * 30), (None, None), (900, ""), (901, None), (902, "x" * 300_000), (903, "Stone é " * 60_000), (904, " " * 200_000)]


@pytest.mark.parametrize("ngram", [1, 3])
def test_plain_count(spark, ngram):
    docs, target = made(240), ["River stone, stone été", None, "", "中文 x1 " * 20]
    d = spark.createDataFrame([(*r, *["c"] * 4) for r in docs], SCHEMA).repartition(3)
    got = resampled(d, spark.createDataFrame([(t,) for t in target], "text string"), ngram=ngram)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, target, ngram)


def test_query(spark, tmp_path):
    target = ["stone river " * 9, "été"]
    for name, docs in (("many", made(120)), ("none", [])):
        for t in ([], target):
            root = f"file://{tmp_path}/{name}{len(t)}"
            spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{root}/documents.parquet")
            spark.createDataFrame(list(enumerate(t)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
            assert sorted((tuple(r) for r in queries.op13_importance(spark, root).collect()), key=str) == brute(docs, t)


def test_stretches():
    text = "".join(random.Random(2).choices("ab é.\n", k=3000)) + "x" * 500 + " end"
    parts = list(stretches(text, 40))
    assert len(parts) > 30 and [w for p in parts for w in WORD.findall(p)] == WORD.findall(text)
    split = splitter()
    assert split.pre_tokenize_str("é1 a-\x7fb") == [("é1", (0, 2)), ("a", (3, 4)), ("b", (6, 7))]
    n, at, times = counted("A b a", split, 2)
    assert n == 3 and dict(zip(at.tolist(), times.tolist(), strict=True)) == Counter(zlib.crc32(f) % 10000 for f in (b"a", b"b", b"a", b"a b", b"b a"))
