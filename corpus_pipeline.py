"""The training-data pipeline over `documents`: quality rules, language ID, n-gram Jaccard join, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; `run` writes every stage's
rows into the shared folder and rereads them as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecshift.llm.common import materialize, table
from vecshift.llm.jaccard import similarity_classes
from vecshift.llm.language import keep_identified
from vecshift.llm.packing import pack_documents
from vecshift.llm.quality import keep_quality
from vecshift.llm.substrings import dedup_spans


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior probability of being good reaches one half and that pass the base rules."""
    return keep_quality(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language, with score one half at least."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of similar documents: five-word shingles, Jaccard 0.8 and more.
    Documents with a null id link with nothing and stay. Where an id is repeated, rows are removed one by one: of rows with
    equal id and text one stays, and different texts under one id are documents of their own, of which the first by hash
    has the id's place in the order and the others come after all ids."""
    key, digest = F.col("doc_id").cast("long"), F.xxhash64("text")
    ids = docs.where(key.isNotNull()).groupBy(key.alias("__id")).agg(F.count(F.lit(1)).alias("n"), F.min(digest).alias("__first")).where("n > 1").drop("n")
    if ids.isEmpty():
        rows = docs.withColumn("__key", key)
    else:
        both = docs.join(ids, key == F.col("__id"), "left")
        late = F.xxhash64("__id", "text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
        both = both.withColumn("__key", F.when(F.col("__first").isNull() | (digest == F.col("__first")), key).otherwise(late))
        once = both.where("__first IS NOT NULL").dropDuplicates(["__key"])
        rows = materialize(both.where("__first IS NULL").unionByName(once).select(*docs.columns, "__key"), "rows")
    classes = similarity_classes(rows, n=5, percent=80, key="__key")
    extra = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("__extra")).distinct()
    return rows.join(extra.hint("shuffle_hash"), F.col("__key") == F.col("__extra"), "left_anti").drop("__key")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with repeated passages taken out of all but their first occurrence."""
    return dedup_spans(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("best-fit packing", packing),
]
#: Expectation-maximisation, learned language models, components and packing are beyond SQL; tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i}")
    return docs
