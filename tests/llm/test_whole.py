"""Findings of reviews: what an operator once left out."""

import random

from pyspark.sql import functions as F

from revisit_spark.llm.decontaminate import decontaminated
from revisit_spark.llm.minhash import without_near_duplicates
from revisit_spark.llm.secrets import candidates, secrets
from revisit_spark.llm.suffixes import _beside, _common

JWT = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.abcDEF_123-x"
SECRETS = [
    ("password = correcthorsebattery", "correcthorsebattery"),
    ("token=AbCdEfGhIjKlMnOpQr", "AbCdEfGhIjKlMnOpQr"),
    ("pwd: hunt3r!", "hunt3r!"),
    ("password=a1", "a1"),
    ("see ghp_" + "aB3dE6gH9" * 4 + " there", "ghp_" + "aB3dE6gH9" * 4),
    (f"Authorization: Bearer {JWT}", JWT),
    ("open postgres://u:pw1@host now", "postgres://u:pw1@host"),
    ('{"a":1,"b":{"password":"qW,7x"},"c":2}', "qW,7x"),
    ("user=bob,secret=x9Yz,port=1", "x9Yz"),
]
FALSE = ["call 555-123-4567 or 20240131", "mail bob7@example.org", "password=changeme token=null", "section chapter12 paragraph3"]


def test_secrets_of_any_form(spark):
    rows = [(i, t) for i, (t, _) in enumerate(SECRETS)] + [(100 + i, t) for i, t in enumerate(FALSE * 8)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.value) for r in secrets(d).collect()}
    assert {(i, v) for i, (_, v) in enumerate(SECRETS)} <= got
    assert not {i for i, _ in got if i >= 100}
    assert {r.name for r in candidates(d).where(F.col("value") == "x9Yz").collect()} == {"secret"}


def prose(seed, n=60):
    return " ".join("".join(random.Random(f"{seed}-{i}").choices("abcdefgh", k=5)) for i in range(n))


def test_stages_remove_rows_not_ids(spark):
    leak = prose("leak", 12)
    rows = [(None, leak), (None, prose(1)), (7, "so " + leak), (7, prose(2)), (8, prose(3)), (None, prose(1))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    kept = sorted((r.doc_id or 0, r.text) for r in decontaminated(d, bench).collect())
    assert kept == sorted([(0, prose(1)), (0, prose(1)), (7, prose(2)), (8, prose(3))])

    copies = [(5, prose(1)), (4, prose(1) + " end"), (5, prose(2)), (6, prose(3)), (6, prose(3)), (None, prose(4)), (None, prose(4)), (None, prose(5)), (9, prose(5)), (None, prose(6)), (None, None), (None, None)]
    d = spark.createDataFrame(copies, "doc_id long, text string").repartition(3)
    got = without_near_duplicates(d)
    assert got.columns == d.columns
    expect = [(4, prose(1) + " end"), (5, prose(2)), (6, prose(3)), (None, prose(4)), (9, prose(5)), (None, prose(6)), (None, None), (None, None)]
    key = lambda r: (r[0] or 0, r[1] or "")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expect, key=key)


def test_streaks_across_partitions(spark):
    """One document has nearly all entries of a gram, so that its streaks go over many partitions."""
    made = random.Random(3)
    word = lambda: made.randrange(3).to_bytes(4, "big")
    many = [(k, 1, 1 if made.random() < 0.97 else made.randrange(2, 5), b"".join(word() for _ in range(12)), b"".join(word() for _ in range(12))) for k in range(400)]
    d = spark.createDataFrame([(k, v, doc, doc, a, b) for k, v, doc, a, b in many], "run long, value long, lo long, hi long, after binary, before binary")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = {r[0]: (r[1], r[2]) for r in _beside(d).groupBy("run").agg(F.max("left"), F.max("right")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {k: tuple(max(_common(x[i], y[i]) for y in many if y[2] != x[2]) for i in (4, 3)) for x in many for k in (x[0],)}
