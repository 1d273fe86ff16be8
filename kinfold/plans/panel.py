"""The genotype panel that the queries run over, derived from the embeddings table: each vector
is a site, its 64 numbers the two alleles of 32 samples; some sharing and inbreeding is planted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.identity import genotype_index
from kinfold.operators.sites import count_frequencies, normalise_gl, pl_to_likelihood

SAMPLES = 32


def fenced(df: DataFrame, **made: Column) -> DataFrame:
    """Adds columns that filters above are not pushed below: exploding an array adds such a filter
    on its size, into which all that the array is made of would be written once more."""
    row = F.explode(F.array(F.struct(*(c.alias(n) for n, c in made.items()))))
    return df.select("*", row.alias("_made")).select(*df.columns, "_made.*")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, n_alleles, lo, hi, g: arrays over samples."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("site_id"), (F.lit(2) + F.col("label") % 3).cast("int").alias("n_alleles"), "embedding")
    a = F.col("n_alleles")

    def quantised(v: Column) -> Column:
        return F.greatest(F.lit(0), F.least(a - 1, F.floor((v.cast("double") + 0.1875) * a / 0.375).cast("int")))

    q = fenced(e, q=F.transform("embedding", quantised)).drop("embedding")
    at = lambda k: F.get("q", k)
    quarter = F.col("site_id") % 4

    def alleles(s: Column) -> Column:
        first = F.when((s == 1) & (quarter < 3), at(F.lit(0))).otherwise(at(s))
        second = F.when((s == 1) & (quarter == 0), at(F.lit(SAMPLES))).when((s == 4) & (quarter == 0), first).otherwise(at(s + SAMPLES))
        return F.struct(F.least(first, second).alias("lo"), F.greatest(first, second).alias("hi"))

    p = fenced(q, c=F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), alleles))
    g = F.transform("c", lambda c: genotype_index(c["lo"], c["hi"]))
    return fenced(p.select("site_id", "n_alleles", "c"), lo=F.col("c.lo"), hi=F.col("c.hi"), g=g).drop("c")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, n_alleles, sample_id, lo, hi, g."""
    z = sites(spark, sf_dir).select("site_id", "n_alleles", F.posexplode(F.arrays_zip("lo", "hi", "g")).alias("sample_id", "c"))
    return z.select("site_id", "n_alleles", "sample_id", "c.*")


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sites(spark, sf_dir)
    return fenced(s, af=count_frequencies(F.col("n_alleles"), F.concat("lo", "hi")))


def likelihoods(spark: SparkSession, sf_dir: str, tag: str = "PL") -> DataFrame:
    """site_id, n_alleles, af, pl (array over samples of arrays, null where missing) and gl."""
    n = (F.col("n_alleles") * (F.col("n_alleles") + 1) / 2).cast("int")

    def one(g: Column, s: Column) -> Column:
        value = lambda k: F.when((F.col("site_id") + s) % 17 != 0, F.when(k == g, 0).otherwise((10 + (7 * F.col("site_id") + 3 * s + k) % 21).cast("int")))
        return F.transform(F.sequence(F.lit(0), n - 1), value)

    p = fenced(frequencies(spark, sf_dir), pl=F.transform("g", one))
    if tag == "GL":
        gl = F.transform("pl", lambda r: normalise_gl(F.transform(r, lambda x: F.coalesce((-x / 10.0).cast("float").cast("double"), F.lit(float("nan"))))))
    else:
        gl = F.transform("pl", pl_to_likelihood)
    return fenced(p, gl=gl)


PANEL_SQL = """
e AS (SELECT vec_id AS site_id, CAST(2 + label % 3 AS INT) AS n_alleles, embedding FROM embeddings),
q AS MATERIALIZED (SELECT site_id, n_alleles, list_transform(embedding, lambda v: greatest(0, least(n_alleles - 1, CAST(floor((CAST(v AS DOUBLE) + CAST(0.1875 AS DOUBLE)) * n_alleles / CAST(0.375 AS DOUBLE)) AS INT)))) AS a FROM e),
w AS MATERIALIZED (SELECT site_id, n_alleles, CAST(s AS INT) AS sample_id,
    CASE WHEN s = 1 AND site_id % 4 < 3 THEN a[1] ELSE a[s + 1] END AS a1,
    CASE WHEN s = 1 AND site_id % 4 = 0 THEN a[33] WHEN s = 4 AND site_id % 4 = 0 THEN a[s + 1] ELSE a[s + 33] END AS a2
  FROM q, range(32) t(s)),
calls AS (SELECT site_id, n_alleles, sample_id, least(a1, a2) AS lo, greatest(a1, a2) AS hi,
    CAST(greatest(a1, a2) * (greatest(a1, a2) + 1) // 2 + least(a1, a2) AS INT) AS g FROM w),
af AS (SELECT site_id, n_alleles, a, CAST((SELECT count(*) FROM calls c WHERE c.site_id = s.site_id AND c.lo = a) + (SELECT count(*) FROM calls c WHERE c.site_id = s.site_id AND c.hi = a) AS DOUBLE) / 64 AS p
  FROM (SELECT DISTINCT site_id, n_alleles FROM calls) s, range(4) t(a) WHERE a < n_alleles),
afs AS (SELECT site_id, n_alleles, list(p ORDER BY a) AS af FROM af GROUP BY site_id, n_alleles),
lik AS (SELECT site_id, n_alleles, sample_id, CAST(k AS INT) AS k,
    CASE WHEN (site_id + sample_id) % 17 = 0 THEN NULL WHEN k = g THEN 0 ELSE CAST(10 + (7 * site_id + 3 * sample_id + k) % 21 AS INT) END AS pl
  FROM calls, range(10) t(k) WHERE k < n_alleles * (n_alleles + 1) // 2),
geno AS (SELECT a.n_alleles, CAST(j * (j + 1) // 2 + i AS INT) AS g, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM (VALUES (2), (3), (4)) a(n_alleles), range(4) s(i), range(4) t(j) WHERE i <= j AND j < a.n_alleles)
"""
