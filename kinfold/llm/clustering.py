"""Clustering around centroids in exact integers, with Hamerly's bounds.

Each vector keeps its cluster and two bounds: an upper one on the distance to its centroid and
a lower one on that to any other. When centroids move, the upper bound grows by the drift of
the vector's own centroid and the lower one shrinks by the largest drift of the others. While
the upper bound stays below the lower one, or below half the distance from the own centroid to
its nearest neighbour, the cluster can't have changed. Else the upper bound is replaced by the
exact distance, and if that doesn't decide either, all centroids are scanned. Distances are
exact integers and bounds are rounded outward, so that results equal a full scan of every
vector; a bound that meets the other decides nothing, so that ties are always scanned and the
smaller number wins.

The vectors with their clusters and bounds are written to the shared folder in each round. Sums
for the new centroids are Spark's, with map-side partial sums: a row for each cluster; only
those (clusters x components) and the centroids pass through the driver.

Cases: vectors that are null, of another length, or hold null or non-finite components are left
out; rows without an id have ``1:null`` hashed; repeated ids are vectors of their own, and among
the first centroids they stand in the order of their components; with fewer vectors than
centroids each is one; equal centroids: the smaller number gets all; an empty table gives an
empty one; further columns are left out. A component beyond 2^27 as an integer is an error, as
squared distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.shared import discard, small_batches, written

CLUSTERS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
LARGEST = 2**27
STATE = "vec_id long, v array<int>, cluster int, upper double, lower double, distance long"


def above(x: np.ndarray) -> np.ndarray:
    """Square roots that are not below the true ones."""
    return np.nextafter(np.sqrt(np.asarray(x, float)) * (1 + 1e-15), np.inf)


def below(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.sqrt(np.asarray(x, float)) * (1 - 1e-15), -np.inf), 0)


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of v to the rows of c, as integers: [row, centroid]."""
    return np.stack([((v - x) ** 2).sum(1) for x in c], 1)


class Moves:
    """How a batch of vectors goes on to new centroids."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None) -> None:
        self.c, k = centroids, len(centroids)
        gaps = below(squares(centroids, centroids)) / 2
        gaps[np.arange(k), np.arange(k)] = np.inf
        self.half = gaps.min(1)  # half the way to the nearest other centroid
        if before is not None:
            self.drift = above(((centroids - before) ** 2).sum(1))
            self.drift[(centroids == before).all(1)] = 0.0
            self.others = np.array([np.delete(self.drift, i).max(initial=0.0) for i in range(k)])

    def scan(self, v: np.ndarray) -> tuple[np.ndarray, ...]:
        """cluster, distance, upper, lower by all centroids."""
        d = squares(v, self.c)
        cluster = d.argmin(1)  # the first of equal ones
        own = d[np.arange(len(v)), cluster]
        d[np.arange(len(v)), cluster] = np.iinfo(np.int64).max
        second = below(d.min(1)) if len(self.c) > 1 else np.full(len(v), np.inf)
        return cluster, own, above(own), second

    def go_on(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, exact: bool) -> tuple[np.ndarray, ...]:
        """The same from the bounds as they were; scans only where they leave it open. ``exact``: the
        distance of every vector is wanted; else it is -1 where it wasn't needed."""
        cluster, distance = cluster.copy(), np.full(len(v), -1, np.int64)
        upper = np.nextafter(upper + self.drift[cluster], np.inf)
        lower = np.maximum(np.nextafter(lower - self.others[cluster], -np.inf), 0)
        bound = np.maximum(lower, self.half[cluster])
        open_ = np.flatnonzero((upper >= bound) | exact)
        distance[open_] = ((v[open_] - self.c[cluster[open_]]) ** 2).sum(1)
        upper[open_] = above(distance[open_])
        ambiguous = np.flatnonzero(upper >= bound)
        if len(ambiguous):
            cluster[ambiguous], distance[ambiguous], upper[ambiguous], lower[ambiguous] = self.scan(v[ambiguous])
        return cluster, distance, upper, lower


def kept(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the integers of each vector that counts."""
    x = F.col("embedding")
    fine = (F.size(x) == dimensions) & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    fits = F.forall(whole, lambda e: F.abs(e) <= LARGEST)
    v = F.when(fits, F.transform(whole, lambda e: e.cast("int"))).otherwise(F.raise_error(F.lit("a component is beyond 2^27 as an integer")))
    rows = vectors.where(F.coalesce(fine, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest hashes: k rows of each task meet in one, and k stay."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return np.array([r["v"] for r in vectors.orderBy(hashed, "v").limit(k).select("v").collect()], np.int64)


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each cluster's mean, rounded down componentwise; an empty one's centroid stays."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*(F.sum(F.get("v", F.lit(i))) for i in range(centroids.shape[1]))).alias("sums"))
    new = centroids.copy()
    for r in sums.collect():
        new[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return new


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for each vector that
    counts. vectors: vec_id, embedding."""
    small_batches(vectors.sparkSession)
    state = written(kept(vectors, dimensions, scale), "vectors")
    centroids, before = first_centroids(state, k), None

    for step in range(rounds + 1 if len(centroids) else 0):
        if step:
            before, centroids = centroids, moved(state, centroids)
        moves, first, last = Moves(centroids, before), not step, step == rounds

        def run(batches: Iterator[pd.DataFrame], moves=moves, first=first, last=last) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                v = np.stack(b.v.to_numpy()).astype(np.int64)
                if first:
                    found = moves.scan(v)
                else:
                    found = moves.go_on(v, b.cluster.to_numpy(), b.upper.to_numpy(), b.lower.to_numpy(), last)
                b["cluster"], b["distance"], b["upper"], b["lower"] = found[0].astype(np.int32), found[1], found[2], found[3]
                b["vec_id"] = b.vec_id.astype("Int64")
                yield b[["vec_id", "v", "cluster", "upper", "lower", "distance"]]

        old, state = state, written(state.mapInPandas(run, STATE), "state")
        discard(old)
    if not len(centroids):
        state = state.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))

    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    spark = vectors.sparkSession
    named = spark.createDataFrame(list(enumerate(names)), "cluster int, centroid_sha256 string")
    sums = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    each = sums.join(named, "cluster").join(F.broadcast(total))  # one row, and a row for each cluster
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Every round as a scan of all vectors against all centroids."""
    def nearest(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (
  SELECT row, vec_id, v, min(struct_pack(d := d, c := c)) AS best FROM (
    SELECT row, vec_id, e.v, c.c, list_sum(list_transform(range(64), lambda i: (e.v[i + 1] - c.v[i + 1]) * (e.v[i + 1] - c.v[i + 1])))::BIGINT AS d FROM e, c{k} c
  ) GROUP BY row, vec_id, v)"""

    def means(k: int) -> str:
        return f"""m{k} AS (SELECT best.c AS c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT best, unnest(range(64)) AS i, unnest(v) AS x FROM a{k}) GROUP BY best.c, i),
g{k} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM m{k} GROUP BY c),
c{k + 1} AS MATERIALIZED (SELECT c{k}.c, coalesce(g{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN g{k} ON g{k}.c = c{k}.c)"""

    steps = ",\n".join(x for k in range(ROUNDS) for x in (nearest(k), means(k)))
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h, v FROM e ORDER BY h, v LIMIT {CLUSTERS})
),
{steps},
{nearest(ROUNDS)}
SELECT vec_id, CAST(best.c AS INT) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.c = best.c
"""


ORACLE_SQL = _sql()
