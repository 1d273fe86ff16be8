"""Exact deduplication by a tree merge of sorted digest runs; DataFrame functions alone.

Each partition of the input is a run: the digests of its normalised texts in order, each with
the smallest identifier that has it and how many rows do. In each round runs are exchanged and
merged, ``FAN`` neighbours into one (three rounds of a binomial tree at a time), until a single
run is left. Wherever two entries meet, they become one only if digest, length and a second
hash agree; the smaller identifier stays. Then each group of two or more goes down the same
tree, from a run to the runs that it was merged of, and so reaches its rows where they are.

How this stays bounded: a run is dealt out by its digests, so that no task holds a whole one.
A digest has one entry in a run, and an entry meets at most ``FAN`` others of its digest at
each level, so that a text that a third of all rows share is never gathered by any task; its
rows meet only those of their own partition. Texts are read once and never shuffled.

Cases: a null text is empty; a text of white space alone is one space and equals no empty one;
of rows with the same smallest id, the first by partition and place stays and the others of
them do not; rows without an id stay only if none of their text has one; equal rows are rows
of their own; an empty table gives an empty one; further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.shared import SPACE, discard, written

FAN = 8
KEY = ("digest", "length", "second")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{SPACE}]+", " ")


def merged(entries: DataFrame, run: Column) -> DataFrame:
    """Runs with one entry for each verified digest: the smallest identifier and the sum of rows."""
    return entries.withColumn("run", run).groupBy("run", *KEY).agg(F.min("least").alias("least"), F.sum("n").alias("n")).sortWithinPartitions("run", "digest")


def exact_dedup(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row."""
    at = F.monotonically_increasing_id()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.shiftright(at, 33).alias("run"), at.alias("row"), F.explode(F.array(normalised(F.col("text")))).alias("text"))
    rows = rows.select("doc_id", "run", "row", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("length"), F.xxhash64("text").alias("second"))
    rows = written(rows, "digests")

    identifier = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    runs = [written(merged(rows.select(*KEY, "run", identifier.alias("least"), F.lit(1).cast("long").alias("n")), F.col("run")), "run")]
    left = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while left > 1:
        runs.append(written(merged(runs[-1], F.floor(F.col("run") / fan)), "run"))
        left = -(-left // fan)

    groups = runs[-1].where("n > 1").select("run", *KEY, "least", "n")
    made = []
    for below in reversed(runs[:-1]):
        up = groups.withColumnRenamed("run", "up")
        groups = written(below.select("run", *KEY).withColumn("up", F.floor(F.col("run") / fan)).join(up, ["up", *KEY]).drop("up"), "groups")
        made.append(groups)
    discard(*made[:-1], *runs[:-1] if made else [])
    found = rows.join(groups, ["run", *KEY], "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    kept = F.coalesce(F.col("row") == F.col("least.row"), F.lit(True))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) AS k, count(*) OVER (PARTITION BY text_sha256) AS group_size, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM n
"""
