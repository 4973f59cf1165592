"""The thin queries opN_<name> over the whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import importance, quality
from .common import ALNUM_WORD, id_remainder, table
from .decontaminate import WINDOW, report
from .importance import resampled
from .language import identified, learn
from .manifest import manifest, proof_digest, verified
from .media import media_columns
from .minhash import near_duplicates
from .mixing import UNIT, WEIGHTS, copies, word_count
from .secrets import secrets
from .substrings import substring_dedup
from .suffixes import repeated_passages
from .tokens import packed_tokens
from .vectors import near_vectors


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_tokens(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", word_count(docs["text"]).alias("size"))
    return copies(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(docs["doc_id"], 3) == 1
    model = quality.learn(docs.where(~held_out), table(spark, sf_dir, "labels"))
    found = quality.scored(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"), path="source").select("doc_id", "place", "name", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), F.length("value").alias("n_chars"), "score")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(docs["doc_id"], 5) == 0
    model = learn(docs.where(~held_out))
    found = identified(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), keep_image=False)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0
    n_chars = docs["n_chars"].cast("decimal(20,0)")  # a larger one than a long still has its digits
    found = verified(manifest(docs, presented={"n_chars": F.when(tampered, n_chars + 1).otherwise(n_chars)}))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op12_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: CRC-32 of the bytes of a hex string, from the polynomial alone; t is the table's one-row relation.
CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS t"


def _crc(hexed: str) -> str:
    each = f"list_transform(range(0, len({hexed}), 2), lambda i: ('0x' || substr({hexed}, i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({each}, lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256), 4294967295), 4294967295)"


def _field(c: str) -> str:
    return f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')"


ORACLE_SQL: dict[str, str] = {
    "op2_mixing": f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source
), w AS (
  SELECT *, (CASE n % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END)::BIGINT AS w, 2 * source_size AS cap FROM s
), r AS (
  SELECT *, cap::DOUBLE / w AS ratio FROM w
), p AS (
  SELECT *,
    (sum(source_size) OVER () * 150 - coalesce(sum(cap) OVER (ORDER BY ratio, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 100)::BIGINT AS rest,
    (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT * 100 AS opened
  FROM r
), f AS (
  SELECT rest AS rest0, opened AS opened0 FROM p WHERE rest::DOUBLE < ratio * opened ORDER BY ratio, n LIMIT 1
), t AS (
  SELECT source, source_size,
    CASE WHEN rest::DOUBLE >= ratio * opened THEN cap::DOUBLE ELSE (rest0 * w)::DOUBLE / opened0::DOUBLE END AS target,
    ('0x' || substr(md5('0:' || coalesce(source, chr(0))), 1, 8))::BIGINT % {UNIT} AS offset0
  FROM p LEFT JOIN f ON true
), k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, offset0,
    CASE WHEN t.source_size > 0 THEN floor(t.target * {UNIT} / t.source_size)::BIGINT ELSE 0 END AS step,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id) - 1 AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * ((((k + 1) * step + offset0) >> 26) - ((k * step + offset0) >> 26)) AS taken FROM k
""",
    "op4_decontaminate": rf"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM_WORD}'), []) AS w FROM documents
), iw AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM_WORD}') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, array_to_string(w[i : i + {WINDOW} - 1], ' ') AS content, least(len(w), {WINDOW}) AS n
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - {WINDOW} + 1, 1))) AS i FROM iw WHERE len(w) > 0)
), pos AS (
  SELECT r, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n
), hit AS (
  SELECT r, i, pos.n, item FROM pos JOIN win ON win.n = pos.n AND win.content = array_to_string(w[i : i + pos.n - 1], ' ')
), words AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS k FROM hit) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN items USING (r)
""",
    "op5_minhash": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS x FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * n_both >= 80 * (na.n + nb.n - n_both)
), reach AS (
  SELECT a AS id, b AS to_id FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.to_id
), c AS (
  SELECT id, min(to_id) AS least FROM reach GROUP BY id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(least, doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id
""",
    "op7_substrings": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), win AS (
  SELECT r, doc_id, i, array_to_string(w[i : i + 49], ' ') AS c FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL)
), firsts AS (
  SELECT c, min(doc_id) AS lo FROM win GROUP BY c HAVING count(*) > 1
), gone AS (
  SELECT r, list_distinct(flatten(list(generate_series(i, i + 49)))) AS k FROM win JOIN firsts USING (c) WHERE lo < doc_id GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(k), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN k IS NULL THEN array_to_string(w, ' ') ELSE array_to_string([w[j] for j in generate_series(1, len(w)) if not list_contains(k, j)], ' ') END) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
""",
    "op11_manifest": f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
f AS (
  SELECT *, coalesce(CASE WHEN {_crc("hex(encode(doc_id::VARCHAR))")} % 7 = 0 THEN n_chars::HUGEINT + 1 END, n_chars) AS shown_chars,
    {_field("doc_id::VARCHAR")} AS a, {_field("source")} AS b, {_field("lang")} AS c, {_field("text")} AS e FROM documents, crc
), d AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS part, sha256(a || b || c || {_field("n_chars::VARCHAR")} || e) AS leaf, sha256(a || b || c || {_field("shown_chars::VARCHAR")} || e) AS shown FROM f
), r AS (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY part) AS size FROM d
), tree AS (
  SELECT part, 0 AS level, rank AS i, size, leaf AS digest FROM r
  UNION ALL
  SELECT part, level + 1, i // 2, (max(size) + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM tree WHERE size > 1 GROUP BY part, level, i // 2
), sub AS (
  SELECT part, digest, row_number() OVER (ORDER BY encode(part)) - 1 AS rank, count(*) OVER () AS size FROM tree WHERE size = 1
), top AS (
  SELECT 0 AS level, rank AS i, size, digest FROM sub
  UNION ALL
  SELECT level + 1, i // 2, (max(size) + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM top WHERE size > 1 GROUP BY level, i // 2
), up AS (
  SELECT part, rank, 0 AS level, size, '' AS proof, shown AS x FROM r
  UNION ALL
  SELECT u.part, u.rank, u.level + 1, (u.size + 1) // 2, u.proof || coalesce(s.digest, ''),
    sha256(CASE WHEN (u.rank >> u.level) % 2 = 1 THEN s.digest || u.x ELSE u.x || coalesce(s.digest, '') END)
  FROM up u LEFT JOIN tree s ON s.part = u.part AND s.level = u.level AND s.i = xor(u.rank >> u.level, 1) WHERE u.size > 1
), over AS (
  SELECT u.part, u.rank, sub.rank AS own, 0 AS level, sub.size, u.proof, u.x FROM up u JOIN sub ON sub.part = u.part WHERE u.size = 1
  UNION ALL
  SELECT o.part, o.rank, o.own, o.level + 1, (o.size + 1) // 2, o.proof || coalesce(s.digest, ''),
    sha256(CASE WHEN (o.own >> o.level) % 2 = 1 THEN s.digest || o.x ELSE o.x || coalesce(s.digest, '') END)
  FROM over o LEFT JOIN top s ON s.level = o.level AND s.i = xor(o.own >> o.level, 1) WHERE o.size > 1
)
SELECT r.doc_id, r.leaf, sub.digest AS subroot, root.digest AS root, sha256(o.proof) AS proof_sha256, o.x AS folded_root, o.x = root.digest AS verified
FROM r JOIN sub USING (part) JOIN over o ON o.part = r.part AND o.rank = r.rank AND o.size = 1, (SELECT digest FROM top WHERE size = 1) root
""",
    "op12_embeddings": """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT a AS r, b AS to_r FROM links UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.to_r
), c AS (
  SELECT reach.r, min(v.vec_id) AS least FROM reach JOIN v ON v.r = reach.to_r GROUP BY reach.r
), n AS (
  SELECT a AS r, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least, vec_id)::BIGINT AS component_id, vec_id IS NOT DISTINCT FROM coalesce(least, vec_id) AS kept
FROM v LEFT JOIN c USING (r) LEFT JOIN n USING (r)
""",
    "op13_importance": rf"""
WITH crc AS ({CRC_TABLE}),
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM_WORD}'), []) AS w FROM documents
), q AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM_WORD}')) AS f FROM benchmark
), dw AS (
  SELECT r, f, count(*) AS n FROM (SELECT r, unnest(w) AS f FROM d) GROUP BY r, f
), words AS (
  SELECT f, {_crc("hex(encode(f))")} % {importance.BUCKETS} AS bucket FROM (SELECT f FROM dw UNION SELECT f FROM q), crc
), s AS (
  SELECT bucket, sum(n) AS s FROM dw JOIN words USING (f) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM q JOIN words USING (f) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + {importance.BUCKETS}) / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + {importance.BUCKETS}))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)
), x AS (
  SELECT r, sum(n * gain)::BIGINT AS weight FROM dw JOIN words USING (f) JOIN g USING (bucket) GROUP BY r
), y AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{importance.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM d LEFT JOIN x USING (r)
), able AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS k, {importance.PERCENT} * count(*) OVER () // 100 AS most FROM y WHERE n_features >= {importance.LEAST_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= most THEN k END AS rank FROM y LEFT JOIN able USING (r)
""",
}

