"""python -m kinfold INPUT.vcf[.gz] OUTPUT: identity coefficients of all pairs of samples."""

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinfold.plans import relatedness
from kinfold.shared import written
from kinfold.sources import tables, vcf


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="kinfold", description=__doc__)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("-f", "--allele-freqs", choices=["estimate", "info"], default="estimate")
    p.add_argument("-t", "--tag", choices=["GL", "PL", "GT"], default="GL")
    p.add_argument("-p", "--threads", type=int, help="shuffle partitions")
    p.add_argument("-i", "--iterations", type=int, default=100)
    p.add_argument("-m", "--minimum-allele-frequency", type=float)
    p.add_argument("-s", "--samples", type=int)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("kinfold").getOrCreate()
    if a.threads:
        spark.conf.set("spark.sql.shuffle.partitions", a.threads)
    names, info = vcf.samples(spark, a.input), a.allele_freqs == "info"
    if a.samples and a.samples > len(names):
        raise ValueError("more samples asked for than there are")
    parsed = vcf.read_gt(spark, a.input, info) if a.tag == "GT" else vcf.read_likelihoods(spark, a.input, a.tag, info)
    sites = written(parsed.sites, "sites")  # the text is read once, and what is counted is noted then
    if a.tag == "GT":
        pairs = relatedness.relatedness_gt(sites, a.iterations, a.samples)
    else:
        pairs = relatedness.relatedness_gl(sites, a.iterations, a.samples, a.minimum_allele_frequency)
    pairs = written(pairs, "pairs")  # the sort of the output would solve them twice
    tables.write_results(pairs, names, a.output)
    n = parsed.counts()
    kept = ", ".join(f"{n[f'alleles_{k}']} with {k} alleles" for k in (2, 3, 4))
    print(f"{n['sites']} sites: {n['not_snp']} are no substitutions, {n['missing']} have missing calls; {kept}", file=sys.stderr)
    found = pairs.agg(F.count("*").alias("pairs"), F.count(F.when(~F.col("converged"), 1)).alias("open")).first()
    print(f"{found['pairs']} pairs", file=sys.stderr)
    if found["open"]:
        print(f"warning: {found['open']} pairs have not converged in {a.iterations} iterations", file=sys.stderr)


if __name__ == "__main__":
    main()
