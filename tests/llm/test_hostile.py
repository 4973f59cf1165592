"""Every operator and the pipeline on tables with nulls, repeats, clashing columns, very long texts, and none."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from revisit_spark.llm import language, media, quality, queries
from revisit_spark.llm.decontaminate import decontaminated, report
from revisit_spark.llm.importance import resampled
from revisit_spark.llm.manifest import manifest, verified
from revisit_spark.llm.minhash import near_duplicates, without_near_duplicates
from revisit_spark.llm.mixing import copies, mix, result_names
from revisit_spark.llm.secrets import secrets
from revisit_spark.llm.substrings import substring_dedup
from revisit_spark.llm.suffixes import repeated_passages
from revisit_spark.llm.tokens import packed_tokens
from revisit_spark.llm.vectors import near_vectors

LONG = " " * 1_000_000
CLASHES = ["target", "copies", "source_size", "_part", "_shift", "_named", "_of", "_key", "_cell", "_row", "lang_pred", "lang_score", "lang_fit", "score", "payload", "_words_of_text", "_again", "row", "_id", "_text", "_spot", "_number", "_stays", "part", "rank", "size", "digest", "held", "leaf", "path", "lo", "hi", "block", "bucket", "n_features", "weight", "group", "n_words", "cls", "w", "n_links", "component"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def prose(seed, n=70):
    return " ".join(f"w{seed}x{i % 9}" for i in range(n))


@pytest.fixture(scope="module")
def hostile(spark):
    same = prose(1)
    texts = [(1, same), (1, same), (1, prose(2)), (None, same), (None, prose(3)), (None, None), (2, ""), (3, None), (4, same + " more"), (5, LONG), (6, "x" * 1_000_000), (7, "!" * 300_000), (8, "é1" * 50_000), (9, prose(4, 20_000)), (9, prose(5)), (10, "password = correcthorsebattery")]
    rows = [(i, t, "en" if k % 2 else "fr", None if k % 3 else "s", 0, *["c"] * len(CLASHES)) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, prose(2, 12)), (None, "never here at all"), (3, None), (4, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1.0), (9, 0.0), (10, 0.7), (4, 0.0), (4, 1.0), (None, 1.0)], "doc_id long, quality double")


def vectors(docs):
    """Hostile vectors: of the texts' lengths, null for null texts, empty for empty ones."""
    n = F.length("text").cast("double")
    return docs.withColumns({"vec_id": F.col("doc_id"), "label": F.col("lang"), "embedding": F.when(n == 0, F.array().cast("array<double>")).when(n > 0, F.array(n, n % 7, F.lit(1.0)))})


def each(docs, bench, labels):
    """Every operator's result on ``docs`` by name, and whether it has one row for each of ``docs``."""
    model = language.learn(docs)
    sized = docs.withColumn("size", F.length(F.coalesce("text", F.lit(""))))
    return {
        "packed_tokens": (packed_tokens(docs), False), "copies": (copies(sized), True), "mix": (mix(docs), False), "repeated_passages": (repeated_passages(docs), False),
        "report": (report(docs, bench), True), "decontaminated": (decontaminated(docs, bench), False), "near_duplicates": (near_duplicates(docs), True), "without_near_duplicates": (without_near_duplicates(docs), False),
        "quality": (quality.scored(docs, quality.learn(docs, labels)), True), "substring_dedup": (substring_dedup(docs), True), "secrets": (secrets(docs, path="source"), False), "language": (language.identified(docs, model), True),
        "manifest": (verified(manifest(docs, presented={"n_chars": F.lit(1)})), True), "resampled": (resampled(docs, bench), True), "near_vectors": (near_vectors(vectors(docs)), True),
        "media": (media.media_columns(docs), True), "images": (media.images(media.media_columns(docs)), True),
    }


def test_hostile_rows(hostile, bench, labels):
    n = hostile.count()
    for name, (found, whole) in each(hostile, bench, labels).items():
        rows = found.count() if name in ("media", "images") else len(found.select(*[c for c in found.columns if c not in ("text", "kept")]).collect())
        assert rows == n or not whole and rows > 0, name


def test_empty_tables(spark, hostile, bench, labels):
    for name, (found, _) in each(hostile.where("false"), bench.where("false"), labels.where("false")).items():
        assert found.count() == 0, name


def test_rows_not_ids(hostile, bench):
    kept = [(r.doc_id, (r.text or "")[:6]) for r in decontaminated(hostile, bench).select("doc_id", "text").collect()]
    assert (1, "w2x0 w") not in kept and len(kept) == hostile.count() - 1
    kept = [(r.doc_id, (r.text or "")[:6], len(r.text or "")) for r in without_near_duplicates(hostile).select("doc_id", "text").collect()]
    assert sum(t[:2] == "w1" for _, t, _ in kept) == 1 and (1, "w1x0 w", len(prose(1))) in kept and (1, "w2x0 w", len(prose(2))) in kept
    assert sum(n == 0 for *_, n in kept) == 3 and (None, "w3x0 w", len(prose(3))) in kept


def test_names_stay_free(hostile):
    sized = hostile.withColumn("size", F.lit(1))
    assert result_names(sized) == ("_source_size", "_target", "_copies") and set(result_names(sized)) <= set(copies(sized).columns)
    assert language.result_names(hostile)[0] == "_lang_pred" and mix(hostile).columns == hostile.columns


def test_pipeline_passes_hostile_rows(spark, hostile, bench, tmp_path):
    for name, rows in (("full", hostile), ("none", hostile.where("false"))):
        root = f"file://{tmp_path}/{name}"
        rows.write.parquet(f"{root}/documents.parquet")
        bench.write.parquet(f"{root}/benchmark.parquet")
        got = corpus_pipeline.run(spark, root).collect()
        assert bool(got) == (name == "full")


def test_every_query_is_registered():
    assert [int(q[2:].split("_")[0]) for q in queries.queries()] == list(range(1, 14))
