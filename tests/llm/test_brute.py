"""Models, hashes and the pipeline against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from revisit_spark.llm import language, media, quality
from revisit_spark.llm.minhash import _centres_apart, near_duplicates
from revisit_spark.llm.mixing import copies
from revisit_spark.llm.secrets import evaluated, findings, learn, marked, scored, secrets
from revisit_spark.llm.tokens import VOCABULARY, Encoder, segments

LANGS = {"en": "the of and house garden river walking under bright stone little morning", "fr": "le la et maison jardin rivière marcher sous clair pierre petit matin"}


def said(lang, seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choice(LANGS[lang].split()) + r.choice(["", "", "s"]) for _ in range(n))


def test_language_scores(spark):
    train = [(i, said(k, f"{k}{i}"), k) for i in range(30) for k in LANGS]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = language.learn(docs, words=8, grams=40)
    low = lambda t: [f" {w.lower()} " for w in re.findall(r"[^\W\d_]+", t)]
    parts = lambda w, n: [w] if n == 0 else [w[i : i + n] for i in range(len(w) - n + 1) if not (n == 1 and w[i] == " ")]
    counts = {(n, k): Counter(g for _, t, lang in train if lang == k for w in low(t) for g in parts(w, n)) for n in range(5) for k in LANGS}
    kept = {}
    for (n, k), c in counts.items():
        room, at = (40 if n else 8), {}
        for m in sorted(set(c.values()), reverse=True):
            level = {g: m for g, x in c.items() if x == m}
            room -= len(level)
            if room < 0:
                break
            at |= level
        kept[n, k] = at
    log = {}
    for n in range(5):
        keys = set().union(*(kept[n, k] for k in LANGS))
        for k in LANGS:
            whole = sum(counts[n, k].values()) + 0.5 * max(len(keys), 1)
            log |= {(n, k, g): math.log((kept[n, k].get(g, 0) + 0.5) / whole) for g in keys}
    texts = [said("en", "x"), said("fr", "y"), "zzz qqq", "stoney riverside", "la river 12", "", None, "été"]
    sums, covered, _ = model.scores(texts)
    for t, got, cover in zip(texts, sums, covered, strict=True):
        for j, k in enumerate(sorted(LANGS)):
            total, fit = 0.0, 0.0
            for w in low(t or ""):
                for n in (0, 4, 3, 2, 1):
                    known = [g for g in parts(w, n) if (n, k, g) in log]
                    if n == 4 or n == 0:
                        fit += (1 if n == 0 else 0.5) * sum(g in kept[n, k] for g in known) / max(1, len(parts(w, n)))
                    if known:
                        total += sum(log[n, k, g] for g in known) / len(known)
                        break
            assert got[j] == pytest.approx(total, abs=1e-4) and cover[j] == pytest.approx(fit, abs=1e-6)


def test_all_labelled_texts_count(spark, monkeypatch):
    """Texts of any number are all counted, also where tasks send what they hold before they end."""
    monkeypatch.setattr(language, "HELD", 50)
    rows = [(i % 3, f"alpha beta w{'abcdefghij'[i % 10]}", "en") for i in range(12_000)] + [(0, "beta gamma", "fr"), (0, None, "fr"), (0, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {(r.lang, r.c) for r in language._counts(language.labelled(docs)).where("n = 0").collect()}
    assert got == {("en", 12_000), ("en", 1_200), ("fr", 1)}
    counts = language._counts(language.labelled(docs))
    least, every = language._least_counts(counts, 2, 2, 1000)
    assert (least[0, "en"], every[0, "en"], least[0, "fr"], every[0, "fr"]) == (12_000, 36_000, 1, 2)


def test_least_fits_are_of_all_texts(spark):
    rows = [("en", "en", x / 1000) for x in range(1000)] + [("en", "fr", 0.0), (None, "en", 0.0), ("fr", "fr", 0.7)]
    found = spark.createDataFrame(rows, "lang string, lang_pred string, lang_fit double").selectExpr("lang", "lang_pred", "1D as lang_score", "lang_fit")
    assert language.least_fits(found) == {"en": pytest.approx(0.0045), "fr": pytest.approx(0.35)}


def test_marks_are_no_letters(spark):
    odd = ["\u0301\u0301", "5\u20e3", "\u0301 42", "...", "e\u0301t\u0301", "\u0301the"]
    assert [len(language.letter_words([t]).begin) for t in odd] == [0, 0, 0, 0, 1, 1]
    words = language.letter_words(["x\u0301\u0301the \u0301of"])
    assert [bytes(words.points[b + 1 : b + n - 1].astype("<u4")).decode("utf-32-le") for b, n in zip(words.begin, words.length, strict=True)] == ["x\u0301\u0301the", "of"]
    docs = spark.createDataFrame([(i, said(k, f"{k}{i}"), k) for i in range(9) for k in LANGS], "doc_id long, text string, lang string")
    got = language.identified(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), language.learn(docs)).collect()
    assert [r.lang_pred == "und" and r.lang_score == 0 for r in got] == [True] * 4 + [False] * 2


def test_texts_that_fit_no_language_go(spark):
    rows = [(i, said(k, f"{k}{i}"), k) for i in range(30) for k in LANGS]
    other = "ich habe gestern einen neuen wagen gekauft weil der alte kaputt war und niemand konnte ihn noch reparieren"
    odd = [(100, other, None), (101, "xq zvkj wpft bnmd hgjk rtzp qwxy", None), (102, "123 !!", None), (103, said("fr", "new"), None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.identify(spark, docs, "").collect()}
    assert kept == {i for i, *_ in rows} | {103}


def test_quality_learns_as_plain_ftrl():
    r = random.Random(5)
    examples = [(np.array(sorted(r.sample(range(50), 6)) + [quality.PLACES]), np.array([r.random() for _ in range(6)] + [1.0]), r.randint(0, 1)) for _ in range(200)]
    leader, z, n = quality.Leader(), Counter(), Counter()
    for at, x, y in examples:
        leader.learn(at, x, y)
        w = {i: 0.0 if abs(z[i]) <= leader.l1 else -(z[i] - math.copysign(leader.l1, z[i])) / ((leader.beta + math.sqrt(n[i])) / leader.alpha + leader.l2) for i in at.tolist()}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at.tolist(), x.tolist(), strict=True))))
        for i, v in zip(at.tolist(), x.tolist(), strict=True):
            g = (p - y) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / leader.alpha * w[i]
            n[i] += g * g
    assert all(leader.z[i] == pytest.approx(z[i]) and leader.n[i] == pytest.approx(n[i]) for i in z)


def test_quality_scores_as_plain_dot_product():
    texts = ["One two, two THREE 44!", "", None, "one", "\n x  y "]
    place, at = quality.features(pa.array(texts))
    model = quality.Weights(np.random.default_rng(1).normal(size=quality.PLACES).astype(np.float32), 0.25)
    for i, got in enumerate(model.scores(pa.array(texts))):
        own = place[at[i] : at[i + 1]].tolist()
        mean = sum(float(model.weights[p]) for p in own) / len(own) if own else 0.0
        assert got == pytest.approx(1 / (1 + math.exp(-(0.25 + quality.SCALE * mean))), abs=1e-6)
    # tokens: one two , two three 44 ! -> 7 of them; 1- and 2-grams, and 1- to 3-grams of shapes
    assert at[1] == 7 + 6 + 7 + 6 + 5 and at[2] == at[3] == at[1]


def test_fractional_and_contradictory_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0.7), (2, 0.0), (2, 1.0)], "doc_id long, quality double")
    assert not quality.learn(docs, labels).weights.any()


def test_media_values(spark):
    texts = [(1, "plain text " * 40), (2, ""), (3, None), (4, "é" * 33), (5, "".join(chr(32 + i % 90) for i in range(5000)))]
    got = {r.doc_id: r for r in media.media_columns(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        raw += bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        image = [list(raw[k : k + 64]) for k in range(0, len(raw), 64)]
        h = len(image)
        small = []
        for y in range(32):
            a, z = y * h // 32, max((y + 1) * h // 32, y * h // 32 + 1)
            small.append([sum(image[k][2 * x] + image[k][2 * x + 1] for k in range(a, z)) / (2 * (z - a)) for x in range(32)])
        low = [round(sum(small[y][x] * math.cos(math.pi * (2 * y + 1) * u / 64) * math.cos(math.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
        middle = sorted(low[1:])[31]
        bits = "".join("1" if x > middle else "0" for x in low)
        assert got[i].feature == f"{int(bits, 2):016x}"
        assert got[i].media_bytes == len(got[i].media) and media.read_png(bytes(got[i].media)).tobytes() == raw


def test_filters_are_chosen_and_undone():
    rng = np.random.default_rng(3)
    heights = np.array([1, 5, 70, 2])
    x = rng.integers(0, 6, (78, 64)).cumsum(axis=1).cumsum(axis=0).astype(np.uint8)
    rows = media.filtered(x, heights)
    assert len(set(rows[:, 0].tolist())) > 1 and (media.unfiltered(rows, heights) == x).all()
    for k in range(5):
        rows[:, 0] = k
        one = np.concatenate([media.unfiltered(r, np.array([len(r)])) for r in np.split(rows, np.cumsum(heights)[:-1])])
        assert (media.unfiltered(rows, heights) == one).all()


def test_mixing_misses_by_less_than_the_largest(spark):
    r = random.Random(9)
    rows = [(i, f"s{i % 7}", int(r.paretovariate(0.7) * 10)) for i in range(400)] + [(1000 + i, None, 5) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    for seed in range(3):
        by = {}
        for x in copies(docs, seed=seed).collect():
            by.setdefault(x.source, []).append(x)
        for found in by.values():
            assert abs(sum(x.copies * x.size for x in found) - found[0].target) < max(x.size for x in found) + 1 and all(0 <= x.copies <= 2 for x in found)


def test_blocks_and_pairs_find_the_same(spark):
    """A bucket of far more than 64 members that differ: compared in blocks, and by pairs."""
    r = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(240):
        own = list(base)
        for k in r.sample(range(60), r.choice([1, 4, 6, 8])):
            own[k] = f"u{r.randint(0, 60)}"
        rows.append((i, " ".join(own)))
    sets = {i: {tuple(t.split()[k : k + 2]) for k in range(59)} for i, t in rows}
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    expect = {i: top(i) for i in sets}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for large_from in (2, 64, 100_000):
        assert {x.doc_id: x.component_id for x in near_duplicates(docs, 2, large_from=large_from).collect()} == expect


def test_forest_drops_false_findings(spark):
    """People's labels: long random values are secrets, though no name or format says so."""
    r = random.Random(2)
    made = lambda n: "".join(r.choice("abcdefghjkmnpqrstuvwxyz23456789ABCDEFGH") for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        true = i % 2 == 0
        value = made(32) + "7" if true else f"section{r.randint(10, 9999)}"
        rows.append((i, f"we saw {value} {'in the vault' if true else 'of the book'}"))
        labels.append((i, value, int(true)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = spark.createDataFrame(labels, "doc_id long, value string, label int")
    described = marked(findings(docs).drop("label"), told)
    result = evaluated(described)
    assert result["secrets"] > 10 and result["others"] > 10 and result["precision"] > 0.95 and result["recall"] > 0.95
    kept = {x.doc_id for x in secrets(docs, labels=told).collect()}
    assert kept == {i for i, _, y in labels if y}
    assert scored(described, learn(described)).where("score is null").count() == 0


def test_encoder_cuts_nowhere_else():
    encoder = Encoder.of(open(VOCABULARY, "rb").read())
    r = random.Random(1)
    for _ in range(30):
        t = "".join(r.choice(["word", "é", " " * 300, "\n" * 700, " ", "\t" * 257, "!", "12", "\x1c"]) for _ in range(12))
        assert encoder.ids(t).tolist() == encoder.encoding.encode_ordinary(t)
    assert len(encoder.ids(" " * 1_000_000)) > 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage's rows from plain Python on a small corpus; the last one by its decoded texts."""
    docs = [(i, said(k, f"p{k}{i}", 30 + i), k, f"s{i % 2}", 0) for i in range(12) for k in LANGS]
    docs = [(n, *d[1:]) for n, d in enumerate(docs)]
    leak = said("en", "leak", 12)
    docs += [(100, docs[0][1], "en", "s0", 0), (101, docs[3][1] + " again", "fr", "s1", 0), (102, f"garden {leak} morning", "en", "s0", 0), (103, "zq xv kwj pfft", None, "s0", 0), (104, None, None, None, 0), (105, "", "en", "s1", 0)]
    root = f"file://{tmp_path}"
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    d.repartition(2).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k in stages] == ["language", "near_duplicates", "decontaminate", "mix", "tokens"]
    ids = lambda x: sorted(r.doc_id for r in x.select("doc_id").collect())
    one = stages["language"](spark, d, root)
    assert ids(one) == [i for i, t, *_ in docs if t and i != 103]
    two = stages["near_duplicates"](spark, one, root)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t, *_ in docs if t and i != 103}
    drop = {b for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert drop == {100, 101} and ids(two) == sorted(set(sets) - drop)
    three = stages["decontaminate"](spark, two, root)
    assert ids(three) == sorted(set(sets) - drop - {102})
    size = {i: len(t.split()) for i, t, *_ in docs if t}
    by = {s: [i for i in sorted(set(sets) - drop - {102}) if docs[i][3] == s] for s in ("s0", "s1")}
    total = sum(size[i] for x in by.values() for i in x)
    four = stages["mix"](spark, three, root)
    assert four.columns == d.columns
    times = Counter(ids(four))
    goal = {"s0": 1.5 * total * 5 / 7, "s1": 1.5 * total * 2 / 7}
    for s, t in goal.items():
        cap = 2 * sum(size[i] for i in by[s])
        goal[s] = cap if t > cap else t
    goal = {s: t + (1.5 * total - sum(goal.values()) if t < 2 * sum(size[i] for i in by[s]) else 0) for s, t in goal.items()}
    for s, own in by.items():
        assert abs(sum(times[i] * size[i] for i in own) - goal[s]) <= max(size[i] for i in own) and all(times[i] <= 2 for i in own)
    encoder = Encoder.of(open(VOCABULARY, "rb").read())
    five = corpus_pipeline.run(spark, root)
    parts = {}
    for r in segments(five).select("doc_id", "start", "ids").collect():
        parts.setdefault((r.doc_id, r.start), []).append(np.frombuffer(bytes(r.ids), "<u2"))
    assert Counter({i: len(x) for (i, a), x in parts.items() if a == 0}) == times
    for (i, _), found in parts.items():
        assert all(encoder.encoding.decode(x[:-1].tolist()) == docs[i if i < 100 else i - 76][1] for x in found)
    assert five.select(F.sum(F.size("doc_ids"))).first()[0] == sum(times.values())


def test_centres_meet_members_of_other_components_alone(spark):
    rows = [("k", 1, 10, 1, 1), ("k", 2, 10, 1, 1), ("k", 3, 10, 3, 1), ("k", 4, 2, 4, 1), ("m", 5, 10, 5, 5), ("m", 6, 10, 6, 5)]
    split = spark.createDataFrame(rows, "key string, id long, n long, part long, c long").selectExpr("key", "id", "cast(string(id) as binary) as digest", "n", "part", "named_struct('id', c, 'digest', cast(string(c) as binary), 'n', 10L) as centre")
    assert {(r.a, r.b) for r in _centres_apart(split, 80).collect()} == {(1, 3), (5, 6)}
