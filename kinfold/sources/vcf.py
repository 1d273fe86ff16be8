"""VCF text, also gzipped, as one row a site with arrays over samples.

A site whose REF or ALT is not a single base, or with more than three ALTs, is dropped and
counted as not_snp; for hard calls, one with any missing allele is dropped and counted as
missing. Calls that are not diploid, likelihoods of the wrong length, absent tags and
header types that do not fit are errors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import sites as s
from kinfold.sources import lines

TYPES = {"GT": "String", "GL": "Float", "PL": "Integer"}


@dataclass
class Parsed:
    """sites; counters: by status and number of alleles, by a scan of its own; seen: the same sums,
    noted while the sites are read, there once an action has read all of them."""

    sites: DataFrame
    counters: DataFrame
    seen: Observation

    def counts(self) -> dict[str, int]:
        """Sites in all, no SNPs, with missing calls, and kept ones by number of alleles. Waits for
        the first action over the sites."""
        return {k: int(v or 0) for k, v in self.seen.get.items()}


def counted(rows: DataFrame, seen: Observation) -> DataFrame:
    """rows: status, n_alleles. Notes ``Parsed.counts`` as they go by."""
    kept = {f"alleles_{n}": (F.col("status") == "kept") & (F.col("n_alleles") == n) for n in (2, 3, 4)}
    parts = {"not_snp": F.col("status") == "not_snp", "missing": F.col("status") == "missing", **kept}
    return rows.observe(seen, F.count("*").alias("sites"), *(F.count(F.when(c, 1)).alias(n) for n, c in parts.items()))


def _read_here(path: str) -> list[tuple[str, int]]:
    """Files at the path, where pyarrow can reach it; else none."""
    try:
        return lines.files(path)
    except (pa.ArrowException, OSError):
        return []


def header(spark: SparkSession, path: str) -> list[str]:
    """The header's lines, up to the column names: read from the beginning of the first file, and
    no further. Where only Spark can read the path, a filter over its lines, which gives no others."""
    if _read_here(path):
        return lines.first_lines(path, b"#CHROM")
    return list(dict.fromkeys(r["value"] for r in spark.read.text(path).where(F.startswith("value", F.lit("#"))).collect()))


def samples(spark: SparkSession, path: str) -> list[str]:
    return next(x for x in header(spark, path) if x.startswith("#CHROM")).split("\t")[9:]


def check(head: list[str], kind: str, name: str, wanted: str) -> None:
    found = [m[1] for x in head if x.startswith(f"##{kind}=<") and re.search(rf"[<,]ID={name}[,>]", x) and (m := re.search(r"[<,]Type=(\w+)", x))]
    if found != [wanted]:
        raise ValueError(f"the header does not give {kind} {name} as {wanted}")


def text(spark: SparkSession, path: str, tag: str = "", split: int = lines.SPLIT) -> DataFrame:
    """Lines of a file or folder. Gzipped files are cut at their blocks; plain text, and paths that
    only Spark can read, go through its own reader."""
    there = _read_here(path)
    if there and all(n.endswith((".gz", ".bgz")) for n, _ in there):
        return lines.read_lines(spark, path, tag, split)
    return spark.read.text(path)


def records(spark: SparkSession, path: str, tag: str = "", split: int = lines.SPLIT) -> DataFrame:
    """site_id, chrom, pos, ref, alts, info, format, calls and n_alleles (null if no SNP)."""
    f = F.split("value", "\t")
    rows = text(spark, path, tag, split).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    rows = rows.select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).try_cast("long").alias("pos"), F.get(f, F.lit(3)).alias("ref"), F.split(F.get(f, F.lit(4)), ",").alias("alts"), F.get(f, F.lit(7)).alias("info"), F.split(F.get(f, F.lit(8)), ":").alias("format"), F.slice(f, 10, 2**30).alias("calls"))
    return rows.withColumn("site_id", F.xxhash64("chrom", "pos", "ref", "alts")).withColumn("n_alleles", s.snp_status(F.col("ref"), F.col("alts")))


def tagged(tag: str) -> Column:
    """For each sample the text of one tag."""
    place = F.array_position("format", tag).cast("int") - 1
    return F.when(F.array_contains("format", tag), F.transform("calls", lambda c: F.coalesce(s.field(c, place), F.lit(".")))).when(F.col("pos").isNotNull(), F.raise_error(F.concat(F.lit(f"no {tag} data found at "), "chrom", F.lit(":"), F.col("pos").cast("string"))))


def read_gt(spark: SparkSession, path: str, with_af: bool = False, split: int = lines.SPLIT) -> Parsed:
    """sites: site_id, chrom, pos, n_alleles, lo, hi and, if asked for, af from INFO."""
    head = header(spark, path)
    check(head, "FORMAT", "GT", TYPES["GT"])
    if with_af:
        check(head, "INFO", "AF", "Float")
    gt = F.when(F.col("n_alleles").isNotNull(), tagged("GT"))
    rows = records(spark, path, "GT", split).withColumn("gt", gt)
    rows = rows.withColumn("status", F.when(F.col("n_alleles").isNull(), "not_snp").when(s.has_missing(F.col("gt")), "missing").otherwise("kept"))
    seen = Observation()
    counters = s.counters(rows.select("status", "n_alleles"))
    good = counted(rows, seen).where("status = 'kept'").withColumn("a", F.transform("gt", s.decode_gt))
    fits = F.forall("a", lambda x: (F.array_max(x) < F.col("n_alleles")) & (F.array_min(x) >= 0))
    good = good.withColumn("a", F.when(F.coalesce(fits, F.lit(True)), F.col("a")).otherwise(F.raise_error(F.lit("an allele beyond the alternatives"))))
    out = [F.transform("a", lambda x: F.array_min(x)).alias("lo"), F.transform("a", lambda x: F.array_max(x)).alias("hi")]
    if with_af:
        out.append(F.when(F.col("n_alleles").isNotNull(), s.decode_af(F.col("info"), F.size("alts"))).alias("af"))
    return Parsed(good.select("site_id", "chrom", "pos", "n_alleles", *out), counters, seen)


def read_likelihoods(spark: SparkSession, path: str, tag: str = "GL", with_af: bool = False, missing_ok: bool = False, split: int = lines.SPLIT) -> Parsed:
    """sites: site_id, chrom, pos, n_alleles, gl (array over samples of likelihoods), perhaps af."""
    check(header(spark, path), "FORMAT", tag, TYPES[tag])
    rows = records(spark, path, tag, split).withColumn("status", F.when(F.col("n_alleles").isNull(), "not_snp").otherwise("kept"))
    seen = Observation()
    snps = counted(rows, seen).where("n_alleles IS NOT NULL").withColumn("text", tagged(tag))
    n = (F.col("n_alleles") * (F.col("n_alleles") + 1) / 2).cast("int")
    whole = F.transform("text", lambda t: F.when(F.lit(missing_ok) & (t == "."), F.array_join(F.array_repeat(F.lit("."), n), ",")).otherwise(t))
    decode = s.decode_gl if tag == "GL" else s.decode_pl
    gl = F.transform(whole, lambda t: F.when(F.size(F.split(t, ",")) == n, decode(t)).otherwise(F.raise_error(F.concat(F.lit(f"{tag} does not fit the alternatives: "), t))))
    # Filters that a reader's plan adds may be evaluated before the one above: no value for others.
    snp = F.col("n_alleles").isNotNull()
    gl = F.when(snp, gl)
    out = [F.when(snp, s.decode_af(F.col("info"), F.size("alts"))).alias("af")] if with_af else []
    return Parsed(snps.select("site_id", "chrom", "pos", "n_alleles", gl.alias("gl"), *out), s.counters(rows.select("status", "n_alleles")), seen)


def call_text(a: Column, b: Column, phased: bool = False) -> Column:
    """Calls of all samples from arrays of their two alleles; null or negative ones are missing."""
    sep = "|" if phased else "/"
    there = lambda x: F.coalesce(x >= 0, F.lit(False))
    return F.zip_with(a, b, lambda x, y: F.when(there(x) & there(y), F.concat_ws(sep, x.cast("string"), y.cast("string"))).otherwise(f".{sep}."))


def af_text(af: Column) -> Column:
    """INFO of the alternatives' frequencies, in six digits."""
    return F.concat(F.lit("AF="), F.array_join(F.transform(F.slice(af, 2, F.greatest(F.size(af) - 1, F.lit(0))), lambda x: F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")), ","))


def likelihood_text(values: Column) -> Column:
    """Likelihoods of all samples from an array of arrays; null ones, and ones with a null, are missing."""
    return F.transform(values, lambda v: F.when(F.forall(v, lambda x: x.isNotNull()), F.array_join(v.cast("array<string>"), ",")).otherwise("."))


def write_gt(sites: DataFrame, names: list[str], path: str, parts: int | None = None) -> None:
    """sites: chrom, pos, ref, alts (array), calls (array of text; or lo and hi, arrays of alleles),
    and perhaps af (array), which goes to INFO. The folder is as ``write_records`` says."""
    calls = F.col("calls") if "calls" in sites.columns else call_text(F.col("lo"), F.col("hi"))
    write_records(sites, calls, '<ID=GT,Number=1,Type=String,Description="Genotype">', names, path, parts)


def write_likelihoods(sites: DataFrame, names: list[str], path: str, tag: str = "PL", parts: int | None = None) -> None:
    """The same for likelihoods: sites has a column of the tag's name in lower case, an array over
    samples of arrays, in the tag's own scale (PL: integers, GL: logarithms)."""
    write_records(sites, likelihood_text(F.col(tag.lower())), f'<ID={tag},Number=G,Type={TYPES[tag]},Description="Genotype likelihoods">', names, path, parts)


def write_records(sites: DataFrame, calls: Column, kind: str, names: list[str], path: str, parts: int | None = None) -> None:
    """sites with calls, one text a sample, under the FORMAT that ``kind`` describes.

    The folder's parts are gzip members in the order of the sites, the header at the beginning of
    the first, so that they can be joined into one file as they are. Beside them, in ``_places``,
    stands which part holds which positions. ``parts``: how many; else as Spark sees fit."""
    spark, with_af, tag = sites.sparkSession, "af" in sites.columns, kind[4 : kind.index(",")]
    head = ["##fileformat=VCFv4.2"] + ['##INFO=<ID=AF,Number=A,Type=Float,Description="Allele frequency">'] * with_af
    head += [f"##FORMAT={kind}", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])]
    info = af_text(F.col("af")) if with_af else F.lit(".")
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", F.array_join("alts", ","), F.lit("."), F.lit("PASS"), info, F.lit(tag), F.array_join(calls, "\t"))
    body = sites.select(F.lit(1).alias("kind"), F.col("chrom").cast("string").alias("chrom"), F.col("pos").cast("long").alias("pos"), line.alias("value"))
    rows = spark.createDataFrame([(0, "", 0, "\n".join(head))], "kind int, chrom string, pos long, value string").unionByName(body)
    order = ["kind", "chrom", "pos", "value"]
    rows.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order).select("value").write.text(path, compression="gzip")
    at = F.split("value", "\t")
    back = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).select(F.input_file_name().alias("part"), at[0].alias("chrom"), at[1].cast("long").alias("pos"))
    back.groupBy("part", "chrom").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n_sites")).coalesce(1).write.parquet(f"{path}/_places")


def read_region(spark: SparkSession, path: str, chrom: str, first: int, last: int) -> DataFrame:
    """Records of a folder of ``write_gt`` between two positions, from the parts that hold any."""
    places = spark.read.parquet(f"{path}/_places").where((F.col("chrom") == chrom) & (F.col("first") <= last) & (F.col("last") >= first))
    parts = sorted(r["part"] for r in places.select("part").distinct().collect())
    f = F.split("value", "\t")
    rows = spark.read.text(parts) if parts else spark.createDataFrame([], "value string")
    rows = rows.where(~F.startswith("value", F.lit("#"))).select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).try_cast("long").alias("pos"), F.get(f, F.lit(3)).alias("ref"), F.split(F.get(f, F.lit(4)), ",").alias("alts"), F.get(f, F.lit(7)).alias("info"), F.slice(f, 10, 2**30).alias("calls"))
    return rows.where((F.col("chrom") == chrom) & F.col("pos").between(first, last))
