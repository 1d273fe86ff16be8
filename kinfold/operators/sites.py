"""Sites: filters, decoding of calls and likelihoods, frequencies, reduction. All row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once a row, also where it is used within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


BASE = "^[ACGTacgt]$"


def snp_status(ref: Column, alts: Column) -> Column:
    """Number of bases of a site that is a substitution of 2 to 4 single bases; else null."""
    fine = ref.rlike(BASE) & F.forall(alts, lambda a: a.rlike(BASE)) & F.size(alts).between(1, 3)
    return F.when(F.coalesce(fine, F.lit(False)), F.size(alts) + 1)


def field(call: Column, place: Column) -> Column:
    """The place-th (from 0) part of a sample's column."""
    return F.get(F.split(call, ":"), place)


def has_missing(calls: Column) -> Column:
    return F.exists(calls, lambda c: F.contains(c, F.lit(".")))


def decode_gt(call: Column) -> Column:
    """Two allele numbers from text like 0/1 or 1|0; an error if there are not just two."""
    parts = F.split(call, "[/|]")
    return F.when(F.size(parts) == 2, F.transform(parts, lambda x: x.try_cast("int"))).when(call.isNotNull(), F.raise_error(F.concat(F.lit("not a diploid call: "), call)))


def decode_gl(text: Column) -> Column:
    """10^(gl - max gl) from log10 likelihoods, read as 32-bit floats; a lone entry '.' is NaN."""
    values = F.transform(F.split(text, ","), lambda x: F.coalesce(x.try_cast("float").cast("double"), F.lit(float("nan"))))
    return normalise_gl(values)


def normalise_gl(values: Column) -> Column:
    top = F.coalesce(F.array_max(F.filter(values, lambda x: ~F.isnan(x))), F.lit(float("nan")))
    return F.transform(values, lambda x: F.pow(F.lit(10.0), x - top))


def decode_pl(text: Column) -> Column:
    return pl_to_likelihood(F.transform(F.split(text, ","), lambda x: x.try_cast("int")))


def pl_to_likelihood(values: Column) -> Column:
    """10^(-pl / 10); missing entries are NaN."""
    return F.transform(values, lambda x: F.coalesce(F.pow(F.lit(10.0), -x / 10.0), F.lit(float("nan"))))


def decode_af(info: Column, n_alts: Column) -> Column:
    """Frequencies from INFO: that of the reference is what the others, as 32-bit floats, leave
    of 1. An error unless there is one for each alternative."""
    alts = F.transform(F.split(F.regexp_extract(info, r"(?:^|;)AF=([^;]*)", 1), ","), lambda x: x.try_cast("float").cast("double"))
    total = F.aggregate(alts, F.lit(0.0), lambda a, b: a + b)
    af = F.concat(F.array(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))), alts)
    return F.when(F.size(alts) == n_alts, af).otherwise(F.raise_error(F.lit("AF does not fit the alternatives")))


def count_frequencies(n_alleles: Column, alleles: Column) -> Column:
    """Share of each allele among all alleles of a site."""
    return F.transform(F.sequence(F.lit(0), n_alleles - 1), lambda a: F.size(F.filter(alleles, lambda x: x == a)) / F.size(alleles).cast("double"))


def panel_frequencies(n_alleles: Column, alleles: Column) -> Column:
    """Share of each allele among the alleles of a panel; missing ones (null or negative) don't
    count, and where none is left all shares are 0."""
    seen = F.filter(alleles, lambda x: x >= 0)
    share = lambda a, all_: F.when(F.size(all_) == 0, F.lit(0.0)).otherwise(F.size(F.filter(all_, lambda x: x == a)) / F.size(all_).cast("double"))
    return let(seen, lambda all_: F.transform(F.sequence(F.lit(0), n_alleles - 1), lambda a: share(a, all_)))


def complete_and_varied(alleles: Column, n: int) -> Column:
    """Whether all ``n`` alleles of a site are there (not null, not negative) and at least two
    of them differ."""
    return let(F.filter(alleles, lambda x: x >= 0), lambda seen: (F.size(seen) == n) & (F.size(F.array_distinct(seen)) >= 2))


def apply_threshold(af: Column, least: float) -> Column:
    """Frequencies above 0 and below least become 0; the rest is scaled to sum 1."""
    if not 0 <= least <= 1:
        raise ValueError("the minimum allele frequency is outside [0, 1]")
    cut = F.transform(af, lambda x: F.when((x > 0) & (x < least), F.lit(0.0)).otherwise(x))
    total = F.aggregate(cut, F.lit(0.0), lambda a, b: a + b)
    return F.transform(cut, lambda x: F.when(total == 0, F.lit(float("nan"))).otherwise(x / total))


def kept_alleles(af: Column) -> Column:
    """Places of alleles that occur. NaN counts as not occurring."""
    return F.filter(F.sequence(F.lit(0), F.size(af) - 1), lambda i: (F.get(af, i) > 0) & ~F.isnan(F.get(af, i)))


def kept_genotypes(kept: Column) -> Column:
    """Places of genotypes of kept alleles, in their order."""
    return F.flatten(F.transform(kept, lambda j: F.transform(F.filter(kept, lambda i: i <= j), lambda i: (j * (j + 1) / 2).cast("int") + i)))


def reduce_sites(sites: DataFrame) -> DataFrame:
    """sites: site_id, n_alleles, af, gl (array over samples of likelihoods). Alleles that do not
    occur go, with their genotypes; sites with fewer than two alleles left go."""
    gather = lambda source, places: F.transform(places, lambda i: F.get(source, i))
    likelihoods = "gl" in sites.columns

    def reduced(row: Column, k: Column, g: Column) -> Column:
        parts = [F.size(k).alias("n_alleles"), gather(row["af"], k).alias("af")]
        return F.struct(*parts, *([F.transform(row["gl"], lambda x: gather(x, g)).alias("gl")] if likelihoods else []))

    whole = F.struct("af", *(["gl"] if likelihoods else []))
    new = let(whole, lambda row: let(kept_alleles(row["af"]), lambda k: let(kept_genotypes(k), lambda g: reduced(row, k, g))))
    rest = [c for c in sites.columns if c not in ("n_alleles", "af", "gl")]
    return sites.select(*rest, F.explode(F.array(new)).alias("_new")).where("_new.n_alleles >= 2").select(*rest, "_new.*")


def counters(sites: DataFrame) -> DataFrame:
    """Sites by status and number of alleles. sites: status, n_alleles."""
    return sites.groupBy("status", "n_alleles").agg(F.count("*").alias("n_sites"))
