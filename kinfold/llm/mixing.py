"""Mixing sources to target weights by hash-random keys and distributed prefix sums.

Each document gets a random key, a hash of its id. Within a source, documents stand in the
order of their keys, and the mix is read off that order: full epochs first, then as far as
the rest of the budget goes; the document at the cut gives only the words that are left.
Prefix sums of sizes are taken in two steps, so that no task sees a whole source: the key
range is cut into equal bins (a range sort, as keys are uniform), so many that one holds some
``BIN_ROWS`` rows; sizes are summed in each (source, bin) before any shuffle, sums of the bins
before are added up over that small table, and only then each bin adds up its own documents.
Documents are dealt out once, by source and bin, for both the join with those sums and theirs.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share ``share``
times all sizes; none goes above ``epochs`` times its source's size, and what it can't take
is shared by weight among the others (the level at which all is shared out is found by one
sweep over the sources in the order in which they fill up).

Cases: null and empty texts have size 0 and are taken 0 times; a null source is a source of
its own; rows without an id get their keys from their texts; equal rows stand next to each
other in any order, which changes no row's values but for those at the cut; an empty table
gives an empty one; further columns are kept, whatever their names, and those named like a
result column are replaced.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.shared import WORD, free

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
BIN_ROWS = 20_000
ADDED = ("size", "source_size", "target", "taken", "mix_key", "words_before")
HEX_DIGITS = 12  # of the key: 48 bits


def key(seed: str = "mix") -> Column:
    """A random 48-bit integer for a row, the same in each run."""
    text = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HEX_DIGITS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sizes: source, source_size, a row for each source. Adds weight and target. Its windows run
    over a row for each source, not for each document."""
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1)
    s = sizes.withColumn("weight", w.cast("long")).withColumn("cap", F.col("source_size") * epochs)
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_ = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumns({
        "below": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "open": F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "total": F.sum("source_size").over(all_) * F.lit(float(share)),
    })
    level = (F.col("total") - F.col("below")) / F.col("open")
    s = s.withColumn("full", F.col("cap") <= F.col("weight") * level)
    # sources fill up in order: the level holds from the first that does not
    s = s.withColumn("level", F.min(F.when(~F.col("full"), F.struct("below", level.alias("level")))).over(all_)["level"])
    return s.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level"))).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, bin_rows: int = BIN_ROWS) -> DataFrame:
    """The documents with size, source_size, target, mix_key, words_before (its place in the
    source's order, in words) and taken."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ADDED))
    name, bin_, before = free([*docs.columns, *ADDED], "_name", "_bin", "_before")
    bins = -(-docs.count() // bin_rows) or 1
    keyed = docs.withColumns({
        "size": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"),
        "mix_key": key(),
        name: F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")),  # never null, so that one exchange serves join and window
    })
    keyed = keyed.withColumn(bin_, F.floor(F.col("mix_key") / F.lit(2.0 ** (4 * HEX_DIGITS) / bins)).cast("int"))
    by_bin = keyed.groupBy("source", name, bin_).agg(F.sum("size").alias("sum"))
    order = Window.partitionBy(name).orderBy(bin_)
    t = targets(by_bin.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, share, epochs)
    t = t.select(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias(name), "source_size", "target")
    sums = by_bin.select(name, bin_, F.coalesce(F.sum("sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    placed = keyed.join(sums.join(t, name), [name, bin_], "left")
    own = Window.partitionBy(name, bin_).orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("words_before", F.coalesce(F.sum("size").over(own), F.lit(0)) + F.col(before))
    budget = F.floor(F.col("target"))
    rest = [F.least("size", F.greatest(F.lit(0), budget - k * F.col("source_size") - F.col("words_before"))) for k in range(epochs)]
    return placed.withColumn("taken", functools.reduce(operator.add, rest).cast("long")).drop(name, bin_, before)


def copies(mixed: DataFrame, columns: list[str], lengths: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """The mix itself: each document as often as it is taken, the last time cut to the words
    that are left; documents of which nothing is taken go. Columns named in ``lengths`` hold
    the length of the text; where that is cut, they follow it."""
    (copy,) = free(mixed.columns, "_copy")
    full = F.col("taken").cast("double") / F.col("size")
    left = F.col("taken") % F.col("size")
    rows = mixed.where("taken > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.ceil(full).cast("int"))))
    word_ends = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = (F.col(copy) == F.ceil(full)) & (left > 0)
    whole = {c: F.col(c) for c in columns}
    new = whole | {"text": F.array_join(F.slice(word_ends, 1, F.greatest(left, F.lit(1)).cast("int")), "")}
    new |= {c: F.length(new["text"]).cast(rows.schema[c].dataType) for c in columns if c in lengths}
    return rows.select(*(F.when(cut, new[c]).otherwise(whole[c]).alias(c) if new[c] is not whole[c] else whole[c] for c in columns))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 12) AS BIGINT) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 2 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM s
), f AS (
  SELECT *, CAST(coalesce(sum(cap) OVER before, 0) AS BIGINT) AS below,
         CAST((sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0) AS BIGINT) AS open,
         CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) AS total
  FROM w WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT *, cap <= weight * ((total - below) / open) AS is_full, (total - below) / open AS lv FROM f
), t AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE weight * (min_by(lv, below) FILTER (WHERE NOT is_full) OVER ()) END AS target
  FROM g
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS words_before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       least(size, greatest(0, CAST(floor(target) AS BIGINT) - words_before))
     + least(size, greatest(0, CAST(floor(target) AS BIGINT) - source_size - words_before)) AS taken
FROM p
"""
