"""Queries that write files and read them back, against their SQL; likelihoods as VCF."""

import gzip

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions.identity import fisher_rao
from kinfold.plans import queries
from kinfold.sources import lines, vcf

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["vcf_hard_calls", "vcf_counters", "vcf_region", "vcf_likelihoods", "results_file", "truth_file", "comparator_file", "fisher_rao_eval"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("supplier", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(queries.ORACLE_SQL[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns) and len(want) > 3
    assert sorted(map(tuple, want[columns].values.tolist())) == sorted(map(tuple, got[columns].values.tolist()))


@pytest.mark.parametrize("tag", ["PL", "GL"])
def test_likelihoods_as_vcf(spark, tmp_path, tag):
    """Records that are no substitutions stand between, with lengths and frequencies that do not
    fit; filters over the decoded arrays must not reach them."""
    one = [0, 10, 20] if tag == "PL" else [0.0, -1.0, -2.0]
    rows = [("1", 5, "A", ["C"], [one, None], [0.5, 0.5]), ("1", 7, "AT", ["C"], [[one[1]], [one[1]]], [0.5]), ("1", 9, "G", ["T"], [one[::-1], [one[0], None, one[0]]], [0.25, 0.75])]
    value = "int" if tag == "PL" else "double"
    made = spark.createDataFrame(rows, f"chrom string, pos long, ref string, alts array<string>, {tag.lower()} array<array<{value}>>, af array<double>")
    out = str(tmp_path / "out")
    vcf.write_likelihoods(made, ["a", "b"], out, tag, parts=3)
    text = b"".join(gzip.decompress(open(p.removeprefix("file:"), "rb").read()) for p, _ in lines.files(out)).decode().splitlines()
    assert text[2] == f'##FORMAT=<ID={tag},Number=G,Type={vcf.TYPES[tag]},Description="Genotype likelihoods">' and text[4].split("\t")[8:] == [tag, ",".join(map(str, one)), "."]
    read = vcf.read_likelihoods(spark, out, tag, with_af=True, missing_ok=True).sites
    got = {(r["pos"], r["k"], r["g"]): r["v"] for r in read.select("pos", F.posexplode("gl").alias("k", "row")).select("pos", "k", F.posexplode("row").alias("g", "v")).collect()}
    want = {5: [[1, 0.1, 0.01], [np.nan] * 3], 9: [[0.01, 0.1, 1], [np.nan] * 3]}
    assert {p for p, _, _ in got} == {5, 9} and len(got) == 12
    for p, samples in want.items():
        for k, v in enumerate(samples):
            assert np.allclose([got[p, k, g] for g in range(3)], v, equal_nan=True)
    af = {(r["pos"], r["a"]): r["p"] for r in read.select("pos", F.posexplode("af").alias("a", "p")).collect()}
    assert af == {(5, 0): 0.5, (5, 1): 0.5, (9, 0): 0.25, (9, 1): 0.75}


def test_fisher_rao(spark):
    """Nothing between equal points (rounding would take the cosine beyond 1), pi between corners."""
    rows = [([0.1] * 10, [0.1] * 10), ([1.0] + [0.0] * 9, [0.0] * 9 + [1.0]), ([0.5] * 2 + [0.0] * 8, [1.0] + [0.0] * 9)]
    df = spark.createDataFrame(rows, "p array<double>, q array<double>")
    d = fisher_rao([F.get("p", F.lit(k)) for k in range(10)], [F.get("q", F.lit(k)) for k in range(10)])
    got = [r["d"] for r in df.select(d.alias("d")).collect()]
    assert np.allclose(got, [0, np.pi, np.pi / 2], atol=1e-7) and not np.isnan(got).any()
