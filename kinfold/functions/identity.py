"""Identity states of two genotypes: patterns, their probabilities, kinship.

Alleles are i, j for the first sample and k, l for the second. The expressions are SQL text
over columns i, j, k, l and their frequencies pi, pj, pk, pl.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Which of 15 patterns of equal alleles a pair of genotypes has.
MODE = """CASE
  WHEN i = j AND k = l THEN CASE WHEN i = k THEN 1 ELSE 2 END
  WHEN i = j THEN CASE WHEN i = k THEN 3 WHEN i = l THEN 4 ELSE 5 END
  WHEN k = l THEN CASE WHEN i = k THEN 6 WHEN j = k THEN 7 ELSE 8 END
  WHEN i = k AND j = l THEN 9 WHEN i = l AND j = k THEN 10
  WHEN i = k THEN 11 WHEN i = l THEN 12 WHEN j = k THEN 13 WHEN j = l THEN 14 ELSE 15 END"""

# For each state 1 to 9, the probability of the pair of genotypes by pattern.
STATES: tuple[dict[int, str], ...] = (
    {1: "pi"},
    {1: "pi*pi", 2: "pi*pk"},
    {1: "pi*pi", 3: "pi*pl", 4: "pi*pk"},
    {1: "pi*pi*pi", 2: "pi*pk*pk", 3: "2*pi*pi*pl", 4: "2*pi*pi*pk", 5: "2*pi*pk*pl"},
    {1: "pi*pi", 6: "pi*pj", 7: "pi*pj"},
    {1: "pi*pi*pi", 2: "pi*pi*pk", 6: "2*pi*pi*pj", 7: "2*pj*pj*pi", 8: "2*pi*pj*pk"},
    {1: "pi*pi", 9: "2*pi*pj", 10: "2*pi*pj"},
    {1: "pi*pi*pi", 3: "pi*pi*pl", 4: "pi*pi*pk", 6: "pi*pi*pj", 7: "pj*pj*pi", 9: "pi*pj*(pi+pj)", 10: "pi*pj*(pi+pj)", 11: "pi*pj*pl", 12: "pi*pj*pk", 13: "pi*pj*pl", 14: "pi*pj*pk"},
    {
        1: "pi*pi*pi*pi", 2: "pi*pi*pk*pk", 3: "2*pi*pi*pi*pl", 4: "2*pi*pi*pi*pk", 5: "2*pi*pi*pk*pl", 6: "2*pi*pi*pi*pj", 7: "2*pj*pj*pj*pi", 8: "2*pk*pk*pi*pj",
        9: "4*pi*pi*pj*pj", 10: "4*pi*pi*pj*pj", 11: "4*pi*pi*pj*pl", 12: "4*pi*pi*pj*pk", 13: "4*pi*pj*pj*pl", 14: "4*pi*pj*pj*pk", 15: "4*pi*pj*pk*pl",
    },
)


def state_sql(state: int, mode: str = "mode") -> str:
    """Probability of the pair of genotypes in one state (1 to 9)."""
    return f"CASE {mode} " + " ".join(f"WHEN {m} THEN {e}" for m, e in STATES[state - 1].items()) + " ELSE 0 END"


def genotype_index(a: Column, b: Column) -> Column:
    """Place of an unordered pair of alleles in triangular order."""
    hi = F.greatest(a, b)
    return (hi * (hi + 1) / 2).cast("int") + F.least(a, b)


def genotypes(n_alleles: int) -> list[tuple[int, int]]:
    return [(i, j) for j in range(n_alleles) for i in range(j + 1)]


def mode(i: int, j: int, k: int, l: int) -> int:
    """MODE for given alleles."""
    if i == j:
        return (1 if i == k else 2) if k == l else 3 if i == k else 4 if i == l else 5
    if k == l:
        return 6 if i == k else 7 if j == k else 8
    if i == k:
        return 9 if j == l else 11
    return (10 if j == k else 12) if i == l else 13 if j == k else 14 if j == l else 15


def joint_genotypes(spark: SparkSession) -> DataFrame:
    """All pairs of genotypes for 2, 3 and 4 alleles and their pattern: 145 rows."""
    rows = [(a, x, y, *g, *h) for a in (2, 3, 4) for x, g in enumerate(genotypes(a)) for y, h in enumerate(genotypes(a))]
    return spark.createDataFrame(rows, "n_alleles int, gx int, gy int, i int, j int, k int, l int").withColumn("mode", F.expr(MODE))


def kinship(d: list[Column]) -> Column:
    return d[0] + 0.5 * (d[2] + d[4] + d[6]) + 0.25 * d[7]


def mirror(d: list) -> list:
    """States as seen from the other sample."""
    return [d[0], d[1], d[4], d[5], d[2], d[3], d[6], d[7], d[8]]


def inbreeding(self_kinship: Column) -> Column:
    return 2 * self_kinship - 1


def total_variation(p: list[Column], q: list[Column]) -> Column:
    return sum(F.abs(a - b) for a, b in zip(p, q, strict=True)) / 2


def fisher_rao(p: list[Column], q: list[Column]) -> Column:
    return 2 * F.acos(F.least(F.lit(1.0), sum(F.sqrt(a * b) for a, b in zip(p, q, strict=True))))


#: Six equalities of the pedigree's four lineages (ij, ik, il, jk, jl, kl) -> state of identity by descent.
CONDENSED = """CASE
  WHEN ij AND kl THEN CASE WHEN ik THEN 1 ELSE 2 END
  WHEN ij THEN CASE WHEN ik OR il THEN 3 ELSE 4 END
  WHEN kl THEN CASE WHEN ik OR jk THEN 5 ELSE 6 END
  WHEN (ik AND jl) OR (il AND jk) THEN 7
  WHEN ik OR il OR jk OR jl THEN 8 ELSE 9 END"""
