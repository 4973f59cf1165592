"""A training corpus from ``documents``, in five stages.

Each stage works on all that the one before it kept and has been written; all but the last return the
columns of ``documents``, whatever further columns it has.

Null, empty and wordless texts have no language and go with the first stage, so do all rows of a table
without labelled languages; an empty table gives an empty corpus. Rows are told apart by their texts and
ids, so null and repeated ids take no other text along; of rows equal in text one stays. Texts of any length pass whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revisit_spark.llm import language
from revisit_spark.llm.common import saved, table
from revisit_spark.llm.decontaminate import decontaminated
from revisit_spark.llm.minhash import without_near_duplicates
from revisit_spark.llm.mixing import mix
from revisit_spark.llm.tokens import packed_tokens


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in one of the labelled languages; those without a letter, in none for sure, or that the likeliest
    one doesn't fit (a language without labels, letters at random), go."""
    names = language.result_names(docs)
    found = saved(language.identified(docs, language.learn(docs)), "identified")  # once, for the least fits and for what stays
    kept = language.has_language(*map(F.col, names), language.least_fits(found, names=names))
    return found.where(kept).select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document may come up to twice."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packed_tokens(docs)


STAGES = [("language", identify), ("near_duplicates", dedup), ("decontaminate", decontaminate), ("mix", mixed), ("tokens", tokens)]
#: Models, sketches and tokenizers are not SQL; tests/llm/test_brute.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
