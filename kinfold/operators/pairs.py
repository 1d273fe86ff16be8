"""Pairs of samples: enumeration, the model of their genotypes, sums over sites.

Genotypes stay one row a site with an array over samples; pairs are made inside a row, so that
the only shuffle is that of the partial sums, keyed by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.functions.components import HALVES, half_sums, known, model_tensor
from kinfold.functions.identity import MODE, joint_genotypes, mirror, state_sql

EPSILON = 1e-8
#: Sites and other samples that a task takes at once.
SLICE, SPAN = 512, 128
D = [f"d{k}" for k in range(1, 10)]
M = [f"m{k}" for k in range(1, 10)]


def sample_pairs(spark: SparkSession, n: int) -> DataFrame:
    """x <= y below n, each sample with itself included. Made by a sequence for each x."""
    return spark.range(n).select(F.col("id").cast("int").alias("x")).withColumn("y", F.explode(F.sequence("x", F.lit(n - 1))))


def named_pairs(samples: DataFrame) -> DataFrame:
    """x <= y with their names. samples: sample_id (from 0 on), name."""
    a, b = (samples.select(F.col("sample_id").cast("int").alias(k), F.col("name").alias(f"name_{k}")) for k in "xy")
    return sample_pairs(samples.sparkSession, samples.count()).join(a, "x").join(b, "y").select("x", "y", "name_x", "name_y")


def pair_rows(sites: DataFrame, columns: tuple[str, ...], limit: int | None = None) -> DataFrame:
    """One row for each site and pair x <= y, with the arrays' entries as <name>_x and <name>_y;
    other columns stay. ``limit``: pairs of the first samples only."""
    zipped = F.arrays_zip(*columns)
    if limit is not None:
        zipped = F.slice(zipped, 1, limit)
    rest = [c for c in sites.columns if c not in columns]
    a = sites.select(*rest, zipped.alias("_all")).select(*rest, "_all", F.posexplode("_all").alias("x", "_x"))
    b = a.select(*rest, "x", "_x", F.posexplode(F.slice("_all", F.col("x") + 1, F.size("_all"))).alias("_k", "_y"))
    return b.select(*rest, "x", (F.col("x") + F.col("_k")).alias("y"), *(F.col("_x")[c].alias(f"{c}_x") for c in columns), *(F.col("_y")[c].alias(f"{c}_y") for c in columns))


def probabilities(df: DataFrame, names: list[str] = M) -> DataFrame:
    """Adds mode and the nine probabilities, over i, j, k, l and af."""
    df = df.withColumn("mode", F.expr(MODE)).withColumns({f"p{c}": F.get("af", F.col(c)) for c in "ijkl"})
    return df.withColumns({n: F.expr(state_sql(s + 1)).cast("double") for s, n in enumerate(names)}).drop("pi", "pj", "pk", "pl")


def site_model(sites: DataFrame) -> DataFrame:
    """For each site (site_id, n_alleles, af) and pair of genotypes the nine probabilities."""
    return probabilities(sites.select("site_id", "n_alleles", "af").join(F.broadcast(joint_genotypes(sites.sparkSession)), "n_alleles"))


def quadratic_terms(sites: DataFrame) -> DataFrame:
    """Rows r, c, q of the upper triangle of Q, the mean over sites of the sum of m m'."""
    model = site_model(sites)
    sums = [F.sum(F.col(M[r]) * F.col(M[c])).alias(f"q{r}_{c}") for r in range(9) for c in range(r, 9)]
    # sites are counted where their first pair of genotypes stands, without an exchange by site
    one = model.agg(*sums, F.count(F.when((F.col("gx") == 0) & (F.col("gy") == 0), 1)).alias("v"))
    parts = F.array(*(F.struct(F.lit(r + 1).alias("r"), F.lit(c + 1).alias("c"), (F.col(f"q{r}_{c}") / F.col("v")).alias("q")) for r in range(9) for c in range(r, 9)))
    return one.select(F.explode(parts).alias("e")).select("e.*")


def linear_terms(sites: DataFrame, limit: int | None = None) -> DataFrame:
    """x, y, v and m1 to m9 summed over sites. sites: site_id, af, lo, hi (arrays over samples)."""
    rows = pair_rows(sites.select("site_id", "af", "lo", "hi"), ("lo", "hi"), limit)
    rows = rows.withColumnsRenamed({"lo_x": "i", "hi_x": "j", "lo_y": "k", "hi_y": "l"})
    return probabilities(rows).groupBy("x", "y").agg(F.count("*").alias("v"), *(F.sum(m).alias(m) for m in M))


def mixture_rows(sites: DataFrame, limit: int | None = None) -> DataFrame:
    """For each site and pair the nine component likelihoods m1 to m9: the sum over pairs of
    genotypes of the samples' likelihoods and the model. sites: site_id, n_alleles, af, gl
    (array over samples of arrays). Sites where either sample has a missing value go.

    Within each task some sites with as many alleles are taken at once; nothing is shuffled."""
    id_type = sites.schema["site_id"].dataType
    schema = T.StructType([T.StructField("site_id", id_type), *(T.StructField(c, T.IntegerType()) for c in ("n_alleles", "x", "y")), *(T.StructField(m, T.DoubleType()) for m in M)])

    def slices(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, int, np.ndarray, np.ndarray]]:
        """site ids, n_alleles, af[v, allele] and likelihoods[v, sample, genotype]."""
        n, samples = b["n_alleles"].to_numpy(zero_copy_only=False), b["samples"].to_numpy(zero_copy_only=False)
        for a, k in sorted(set(zip(n.tolist(), samples.tolist(), strict=True))):
            rows = np.flatnonzero((n == a) & (samples == k))
            for low in range(0, len(rows), SLICE):
                some = b.take(pa.array(rows[low : low + SLICE]))
                af, lik = (some[c].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(some.num_rows, -1) for c in ("af", "flat"))
                yield some["site_id"], a, af, lik.reshape(some.num_rows, k, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, a, af, lik in slices(b):
                model, used = model_tensor(af), lik.shape[1]
                lik, there = known(lik)
                for x in range(used):
                    if x % HALVES == 0:
                        half = half_sums(lik[:, x : x + HALVES], model)
                    for low in range(x, used, SPAN):
                        p, both = np.matmul(lik[:, low : low + SPAN], half[:, x % HALVES]), there[:, x, None] & there[:, low : low + SPAN]
                        site, y = np.nonzero(both)
                        same = (np.full(len(y), k, np.int32) for k in (a, x))
                        columns = [ids.take(pa.array(site)), *same, (y + low).astype(np.int32), *np.ascontiguousarray(p[both].T)]
                        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema.names)

    gl = F.col("gl") if limit is None else F.slice("gl", 1, limit)
    flat = sites.select("site_id", F.col("n_alleles").cast("int").alias("n_alleles"), "af", F.size(gl).alias("samples"), F.flatten(gl).alias("flat")).where("n_alleles BETWEEN 2 AND 4 AND samples > 0")
    return flat.mapInArrow(run, schema)


def uniform_objective(rows: DataFrame, gradient: bool = False, hessian: bool = False) -> DataFrame:
    """At equal weights, for each pair: the mean negative log-likelihood over sites; with its
    gradient g1.. and the upper triangle of its Hessian h1_1.. on request."""
    d = sum(F.col(m) for m in M) / 9 + EPSILON
    rows = rows.withColumn("_d", d)
    aggs = [F.count("*").alias("n_sites"), (-F.avg(F.log("_d"))).alias("nll")]
    if gradient:
        aggs += [(-F.avg(F.col(m) / F.col("_d"))).alias(f"g{k + 1}") for k, m in enumerate(M)]
    if hessian:
        aggs += [F.avg(F.col(M[r]) * F.col(M[c]) / (F.col("_d") * F.col("_d"))).alias(f"h{r + 1}_{c + 1}") for r in range(9) for c in range(r, 9)]
    return rows.groupBy("x", "y").agg(*aggs)


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both directions of each pair; pairs: x, y, d1..d9 and others that are symmetric."""
    other = pairs.where("x < y")
    swapped = dict(zip(D, mirror(D), strict=True))
    back = other.select(*(F.col({"x": "y", "y": "x"}.get(c, swapped.get(c, c))).alias(c) for c in pairs.columns))
    return pairs.unionByName(back)
