"""A training-corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. ``run`` applies them in order, each over what the one before kept,
written as Parquet and read again; a stage's table goes once the next one's is written.

Cases: null and empty texts are scored, fail the rules' base test and go there, have no
near-duplicates, are taken 0 times and have no ids; null ids and repeated ids are kept apart as
each stage's docstring says; further columns pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import bpe, jaccard_join, mixing, quality_classifier, quality_rules
from kinfold.llm.shared import discard, table, written


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels, accepts. Each row is judged
    by itself: equal rows, and rows without an id, go or stay by their texts."""
    columns = docs.columns
    return quality_classifier.classify(docs, table(spark, sf_dir, "labels"), carry=tuple(columns)).where("predicted = 1").select(*columns)


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; each row is judged by itself."""
    columns = docs.columns
    return quality_rules.quality_rules(docs, carry=tuple(columns)).where("kept").select(*columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id, one without an
    id only if none has one. Rows with both id and text in common are one document, of which
    the first as JSON stays; other rows of one id are told apart by a hash of their texts."""
    columns = docs.columns
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id IS NULL OR n > 1")
    if again.isEmpty():  # each row has an id of its own
        gone = jaccard_join.jaccard_components(docs).where("component_id <> doc_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*columns)
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    keyed = docs.select(key.alias("key"), "doc_id", "text", F.struct(*columns).alias("row"))
    found = jaccard_join.jaccard_components(keyed.select(F.col("key").alias("doc_id"), "text")).distinct().withColumnRenamed("doc_id", "key")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    stays = keyed.select("key", "doc_id").distinct().join(found, "key").groupBy("component_id").agg(F.min_by("key", order).alias("stays"))
    gone = found.join(stays, "component_id").where("n_shingles > 0 AND key <> stays").select("key")
    left = keyed.join(gone, "key", "left_anti").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return left.select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights: documents as often as they are taken, the
    last copy of the one at a source's cut shortened to the words that are left."""
    return mixing.copies(mixing.mix(docs), docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the documents' ids, and of what the ids decode to, a row for each."""
    return bpe.digests(bpe.encode(docs))


STAGES = [
    ("quality classifier", classified),
    ("quality rules", ruled),
    ("n-gram Jaccard join", deduplicated),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
