"""The operators as queries over the test tables, with their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import bpe, chat_format, clustering, exact_dedup, html_extract, jaccard_join, lattice_dedup, merkle, mixing, quality_classifier, quality_rules, token_counts, token_files
from kinfold.llm.shared import table

PLANTED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in PLANTED)
    planted = spark.sql(f"SELECT * FROM VALUES {values} AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat_format.digests(chat_format.read_back(chat_format.format_chats(rows)))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents")))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_html_extraction": op1,
    "op2_chat_formatting": op2,
    "op3_byte_bpe": op3,
    "op4_source_mixing": op4,
    "op5_embedding_near_dedup": op5,
    "op6_token_counts": op6,
    "op7_quality_rules": op7,
    "op8_quality_classifier": op8,
    "op9_token_files": op9,
    "op10_ngram_jaccard_join": op10,
    "op11_merkle_manifest": op11,
    "op12_exact_dedup": op12,
    "op13_centroid_clustering": op13,
}
ORACLE_SQL = {
    "op2_chat_formatting": chat_format.ORACLE_SQL,
    "op4_source_mixing": mixing.ORACLE_SQL,
    "op10_ngram_jaccard_join": jaccard_join.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op12_exact_dedup": exact_dedup.ORACLE_SQL,
    "op13_centroid_clustering": clustering.ORACLE_SQL,
}
