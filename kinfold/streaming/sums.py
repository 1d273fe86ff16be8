"""Sums over sites are additive: as sites arrive, each pair's linear terms are updated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.pairs import M, linear_terms


def streaming_linear_terms(sites: DataFrame, path: str, checkpoint: str):
    """sites: a stream of site_id, af, lo, hi. Writes each batch's sums by pair into a folder of its
    own below ``path``; a batch that is run again replaces it, so that it counts once."""

    def add(batch: DataFrame, k: int) -> None:
        linear_terms(batch).write.mode("overwrite").parquet(f"{path}/batch={k}")

    return sites.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, path: str) -> DataFrame:
    """x, y, v and m1 to m9 over all batches so far."""
    return spark.read.parquet(path).groupBy("x", "y").agg(F.sum("v").alias("v"), *(F.sum(m).alias(m) for m in M))


def compacted(spark: SparkSession, path: str, to: str) -> None:
    """The sums so far as one batch elsewhere, to go on from with a new stream."""
    totals(spark, path).write.parquet(f"{to}/batch=-1")
