"""A training corpus from raw documents: five stages, each written and read again.

A stage is a function ``(spark, docs, sf_dir) -> DataFrame``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import capacity_packing, cross_parsing, lsh_forest, pii_boost, quality_trees
from logloom.llm.common import read_table, remainder
from logloom.llm.queries import word_tokens
from logloom.sources.scratch import settle

# Below this score no language stands out from the others.
LEAST_LANGUAGE_SCORE = 0.4


def apart(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on documents whose columns have other names than any that it adds, with the own names back after it.

    ``work`` sees ``doc_id`` and ``text`` under their names, and may add, change
    and filter; what it adds is dropped.
    """
    hidden = {c: f"column {i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    found = work(docs.withColumnsRenamed(hidden))
    return found.select(*[F.col(f"`{hidden.get(c, c)}`").alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter, and those whose language cannot be told."""
    model = cross_parsing.learn(docs, remainder("doc_id", 4) != 2)
    sure = (F.col("lang_pred") != cross_parsing.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return apart(docs, lambda d: cross_parsing.identify(d, model).where(sure))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier calls low quality."""
    narrow = docs.select("doc_id", "text")
    model = quality_trees.learn(narrow, read_table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return apart(docs, lambda d: quality_trees.classify(d, model).where("predicted = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates.

    Rows are told apart by id and text, so a text that shares its id with a
    copy of something else stays.
    """
    found = lsh_forest.near_duplicates(docs.select("doc_id", "text"), text_hash="hash")
    gone = found.where("not kept").select(F.col("doc_id").alias("gone"), F.col("hash").alias("gone_hash"))
    same = (F.col("doc_id") == F.col("gone")) & (F.xxhash64("text") == F.col("gone_hash"))
    return apart(docs, lambda d: d.join(gone, same, "left_anti"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in texts by its kind."""
    found = F.size("pii_spans") > 0
    names = {c.lower(): f"column {i}" for i, c in enumerate(docs.columns)}
    text = F.when(found, pii_boost.redacted(F.col("text"), F.col("pii_spans"))).otherwise(F.col("text"))

    def work(d: DataFrame) -> DataFrame:
        changed = pii_boost.find(d).withColumn("new text", text)
        if "n_chars" in names:
            size = F.col(f"`{names['n_chars']}`")
            kind = dict(d.dtypes)[names["n_chars"]]
            changed = changed.withColumn(names["n_chars"], F.when(found, F.length("new text")).otherwise(size).cast(kind))
        return changed.withColumn("text", F.col("new text"))

    return apart(docs, work)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack documents into training sequences: one row per piece, with its bin and its place in it."""
    return capacity_packing.best_fit(docs, word_tokens())


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("redact_pii", redact_pii),
    ("best_fit_packing", best_fit_packing),
]

# SQL can express neither the classifiers nor the forest: tests compare run() with a sequential version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
