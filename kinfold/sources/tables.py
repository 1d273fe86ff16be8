"""Tab-separated results: writing them, and reading the study's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.identity import kinship
from kinfold.operators.pairs import D, mirrored

NINE = ", ".join(f"jacquard{k} double" for k in range(1, 10))


def results(pairs: DataFrame, names: list[str]) -> DataFrame:
    """The output columns, with samples' names, in the order of pairs."""
    spark = pairs.sparkSession
    table = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    a, b = (F.broadcast(table.select(F.col("id").alias(k), F.col("name").alias(n))) for k, n in (("x", "sample1"), ("y", "sample2")))
    named = pairs.join(a, "x").join(b, "y").orderBy("x", "y")
    nine = [F.col(d).alias(f"jacquard{k + 1}") for k, d in enumerate(D)]
    return named.select("sample1", "sample2", "kinship", *nine, "iterations", "objective", F.log10("condition").alias("condition"))


def write_results(pairs: DataFrame, names: list[str], path: str) -> None:
    results(pairs, names).write.mode("overwrite").csv(path, sep="\t", header=True)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema, nanValue="NaN", positiveInf="Infinity")


def read_estimates(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, f"sample1 string, sample2 string, kinship double, {NINE}, iterations long, objective double, condition double")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, f"rel string, kinship double, {NINE}")


def read_comparator(spark: SparkSession, path: str) -> DataFrame:
    """Another tool's a, b, J1..J9; other columns are left out."""
    df = spark.read.csv(path, sep="\t", header=True)
    return df.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), *(F.col(f"J{k}").cast("double").alias(d) for k, d in enumerate(D, 1)))


def read_frequencies(spark: SparkSession, path: str, column: str = "knownEM") -> DataFrame:
    """One column, by its name in the first line, of a table separated by any white space, perhaps
    gzipped; words that are no number, and places beyond a line's end, are null. Blank lines go;
    an empty file gives an empty table."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    head = lines.first()
    names = head["value"].split() if head else [column]
    if column not in names:
        raise ValueError(f"no column {column} in {path}")
    parts = F.split(F.trim("value"), r"\s+")
    return lines.where(F.col("value") != (head["value"] if head else "")).select(F.get(parts, F.lit(names.index(column))).try_cast("double").alias(column))


def write_truth(truth: DataFrame, path: str) -> None:
    """The table of known relationships: rel, kinship, jacquard1 to jacquard9. truth: rel, d1..d9."""
    own = [F.col(d) for d in D]
    rows = truth.select("rel", kinship(own).alias("kinship"), *(c.alias(f"jacquard{k}") for k, c in enumerate(own, 1)))
    rows.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def tiles(pairs: DataFrame, size: int = 64) -> DataFrame:
    """Kinship and coefficients as blocks of dense matrices: tile_row, tile_col, and arrays over the
    tile's places x * size + y (from its corner; null beyond the samples): kinship, and jacquard
    with nine values each. Both directions of each pair are there; a task gathers size^2 pairs at
    most, and nothing goes through the driver."""
    both = mirrored(pairs.select("x", "y", "kinship", *D))
    at = F.struct(((F.col("x") % size) * size + F.col("y") % size).cast("int").alias("k"), "kinship", F.array(*D).alias("d"))
    found = both.groupBy(F.floor(F.col("x") / size).cast("int").alias("tile_row"), F.floor(F.col("y") / size).cast("int").alias("tile_col")).agg(F.map_from_entries(F.collect_list(F.struct(at["k"], at))).alias("m"))
    places = F.sequence(F.lit(0), F.lit(size * size - 1))
    return found.select("tile_row", "tile_col", F.transform(places, lambda k: F.col("m")[k]["kinship"]).alias("kinship"), F.transform(places, lambda k: F.col("m")[k]["d"]).alias("jacquard"))


def write_tiles(pairs: DataFrame, path: str, size: int = 64) -> None:
    """Tiles as Parquet, a folder for each row of tiles."""
    tiles(pairs, size).withColumn("size", F.lit(size)).repartition("tile_row").write.partitionBy("tile_row").mode("overwrite").parquet(path)


def read_tile(spark: SparkSession, path: str, row: int, col: int):
    """Kinship [x, y] and coefficients [x, y, 9] of one tile, NaN beyond the samples."""
    import numpy as np

    r = spark.read.parquet(path).where((F.col("tile_row") == row) & (F.col("tile_col") == col)).first()
    if r is None:
        raise ValueError(f"no tile {row}, {col}")
    none = [np.nan] * 9
    theta = np.array([np.nan if v is None else v for v in r["kinship"]]).reshape(r["size"], r["size"])
    return theta, np.array([none if v is None else v for v in r["jacquard"]]).reshape(r["size"], r["size"], 9)


def dense(pairs: DataFrame, n: int):
    """Arrays on the driver: coefficients n x n x 9 and kinship n x n, for few samples."""
    import numpy as np

    out, theta = np.full((n, n, 9), np.nan), np.full((n, n), np.nan)
    for r in mirrored(pairs.select("x", "y", "kinship", *D)).toLocalIterator():
        out[r["x"], r["y"]], theta[r["x"], r["y"]] = [r[d] for d in D], r["kinship"]
    return out, theta
