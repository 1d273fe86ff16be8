"""The analyses: allele frequencies, then nine identity coefficients for each pair."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import solver
from kinfold.functions.components import HALVES, component_rows, half_sums, known, mode_tables, model_tensor  # noqa: F401
from kinfold.functions.identity import genotypes, kinship
from kinfold.operators.pairs import D, linear_terms, quadratic_terms, sample_pairs
from kinfold.operators.sites import apply_threshold, count_frequencies, reduce_sites
from kinfold.shared import discard, written

#: Samples in a block; sites that one task may hold for a pair of blocks, or in one unit; pairs
#: whose states are sent to all tasks at once.
BLOCK, LOCAL, UNIT, WAVE = 16, 4096, 1024, 100_000
PAIR = "x int, y int, " + ", ".join(f"{d} double" for d in D) + ", iterations long, objective double, condition double, converged boolean"
UPPER = [(r, c) for r in range(9) for c in range(r, 9)]
SUMS = ["n", "value", *(f"g{k}" for k in range(9)), *(f"h{r}{c}" for r, c in UPPER)]
STATE = "x int, y int, points array<double>, " + ", ".join(f"{n} double" for n in solver.Search.NUMBERS)


def finish(pairs: DataFrame) -> DataFrame:
    """Adds kinship. The condition of a pair that has not converged is NaN, which pandas sends as null."""
    pairs = pairs.withColumn("condition", F.coalesce("condition", F.lit(float("nan"))))
    return pairs.withColumn("kinship", kinship([F.col(d) for d in D])).select("x", "y", "kinship", *D, "iterations", "objective", "condition", "converged")


def with_counted_frequencies(sites: DataFrame) -> DataFrame:
    """Adds af from lo and hi, over all samples."""
    return sites.withColumn("af", count_frequencies(F.col("n_alleles"), F.concat("lo", "hi")))


def solved(x, y, weights, iterations, objective, condition, converged) -> pd.DataFrame:
    """Rows of ``PAIR``."""
    return pd.DataFrame({"x": x, "y": y, **{d: weights[:, k] for k, d in enumerate(D)}, "iterations": iterations, "objective": objective, "condition": condition, "converged": converged})


def relatedness_gt(sites: DataFrame, iterations: int = 100, samples: int | None = None) -> DataFrame:
    """Least squares from hard calls. sites: site_id, n_alleles, lo, hi, and af if it is given.

    Q is 45 sums over sites, collected and sent out with the tasks; each pair's linear term
    comes from one shuffle of partial sums; the small problems of a batch of pairs are solved at
    once."""
    sites = sites if "af" in sites.columns else with_counted_frequencies(sites)
    q = np.zeros((9, 9))
    for r in quadratic_terms(sites).collect():
        q[r["r"] - 1, r["c"] - 1] = q[r["c"] - 1, r["r"] - 1] = r["q"]
    s, sums = solver.Settings(outer=iterations), [f"m{k}" for k in range(1, 10)]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = -b[sums].to_numpy() / b.v.to_numpy()[:, None]
            weights, objective, steps, condition, done = solver.least_squares(q, c, solver.starts(b.x == b.y), s)
            yield solved(b.x, b.y, weights, steps, objective, condition, done)

    terms = linear_terms(sites, samples).select("x", "y", "v", *sums)
    return finish(terms.mapInPandas(solve, PAIR))


def symmetric(lik: np.ndarray, n_alleles: int) -> np.ndarray:
    """The last axis, over genotypes, as a matrix over two alleles."""
    out = np.zeros((*lik.shape[:-1], n_alleles, n_alleles))
    for g, (i, j) in enumerate(genotypes(n_alleles)):
        out[..., i, j] = out[..., j, i] = lik[..., g]
    return out


def likelihood_groups(b: pd.DataFrame, size: int = 256) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Of rows site_id, n_alleles, flat: some hundred at once that have as many alleles and samples, their
    likelihoods as matrices, and which samples have data. An error where none has."""
    for _, same in b.groupby(["n_alleles", b.flat.map(len)]):
        for k in range(0, len(same), size):
            some = same.iloc[k : k + size]
            a = int(some.n_alleles.iloc[0])
            lik = np.stack(some.flat.to_numpy()).astype(float).reshape(len(some), -1, a * (a + 1) // 2)
            there = ~np.isnan(lik).any(2)
            if not there.any(1).all():
                raise ValueError(f"no sample has data at site {some.site_id.to_numpy()[~there.any(1)][0]}")
            yield some, symmetric(lik, a), there


def frequencies_by_rounds(sites: DataFrame, rounds: int) -> DataFrame:
    """site_id and af after so many rounds of expectation-maximisation; sites as below."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for some, lik, there in likelihood_groups(b):
                yield some[["site_id"]].assign(af=solver.expected_frequencies(lik, there, rounds).tolist())

    flat = sites.select("site_id", F.col("n_alleles").cast("int").alias("n_alleles"), F.flatten("gl").alias("flat"))
    return flat.mapInPandas(run, "site_id long, af array<double>")


def estimate_frequencies(sites: DataFrame, iterations: int = 100, carry: bool = False) -> DataFrame:
    """Maximum likelihood frequencies of each site (site_id, n_alleles, gl), samples with a missing
    value left out. A row is a site; nothing is shuffled; sites with as many alleles are solved
    some hundred at once. ``carry``: n_alleles and gl stay, so that nothing has to be joined back
    and equal records stay apart."""
    s = solver.Settings(outer=iterations)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for some, lik, there in likelihood_groups(b):
                r = solver.frequencies(lik, there, s)
                found = some[["site_id", "n_alleles", "flat"]] if carry else some[["site_id"]]
                yield found.assign(af=r.x.tolist(), af_iterations=r.iterations, af_objective=r.f, af_converged=r.converged)

    schema = "site_id long, af array<double>, af_iterations long, af_objective double, af_converged boolean" + ", n_alleles int, flat array<double>" * carry
    out = sites.select("site_id", F.col("n_alleles").cast("int").alias("n_alleles"), F.flatten("gl").alias("flat")).mapInPandas(run, schema)
    if not carry:
        return out
    g = (F.col("n_alleles") * (F.col("n_alleles") + 1) / 2).cast("int")
    rows = F.transform(F.sequence(F.lit(0), (F.size("flat") / g).cast("int") - 1), lambda k: F.slice("flat", k * g + 1, g))
    return out.withColumn("gl", rows).drop("flat")


def no_site(x, y) -> ValueError:
    return ValueError(f"samples {x} and {y} share no site")


def by_tile(sites: DataFrame, used: int, block: int, s: solver.Settings) -> DataFrame:
    """For few sites: samples are cut into blocks, and each pair of blocks is a group that gets the
    likelihoods of those samples alone and solves all its pairs at once."""
    blocks = -(-used // block)
    tiles = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(blocks) for j in range(i, blocks)))
    part = lambda b: F.flatten(F.slice("gl", b * block + 1, F.least(F.lit(block), F.lit(used) - b * block)))
    rows = sites.select("n_alleles", "af", "gl", F.explode(tiles).alias("t"))
    rows = rows.select("n_alleles", "af", F.col("t.i").alias("i"), F.col("t.j").alias("j"), part(F.col("t.i")).alias("a"), part(F.col("t.j")).alias("b"))
    # each pair of blocks is a group even if no site is left for it
    every = sites.sparkSession.range(1).select(F.explode(tiles).alias("t")).select("t.*")
    rows = rows.unionByName(every, allowMissingColumns=True)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        pdf = pdf[pdf.n_alleles.notna()].astype({"n_alleles": int})
        if not len(pdf):
            raise no_site(i * block, j * block)
        xs, ys = np.arange(i * block, min(used, (i + 1) * block)), np.arange(j * block, min(used, (j + 1) * block))
        found: dict[int, list] = {x: [] for x in xs}
        for n, g in pdf.groupby("n_alleles"):
            model = model_tensor(np.stack(g.af.to_numpy()).astype(float))
            a, b = (np.stack(g[c].to_numpy()).astype(float).reshape(len(g), -1, n * (n + 1) // 2) for c in "ab")
            for x in xs:
                found[x].append(component_rows(a[:, x - xs[0]], b[:, ys >= x], model))
        p, there = (np.concatenate([np.concatenate([part[k] for part in found[x]], 1) for x in xs]) for k in (0, 1))
        x, y = np.array([(x, y) for x in xs for y in ys if y >= x]).T
        if not there.any(1).all():
            raise no_site(x[~there.any(1)][0], y[~there.any(1)][0])
        r = solver.mixtures(p, there, solver.starts(x == y), s)
        return solved(x, y, r.x, r.iterations, r.f, r.condition, r.converged)

    return rows.groupBy("i", "j").applyInPandas(run, PAIR)


def units(sites: DataFrame, used: int, size: int) -> DataFrame:
    """Some ``size`` sites with as many alleles in one row, of all samples used: n_alleles, and af
    and gl as the bytes of arrays. Made within each task; nothing is shuffled."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, list] = {}

        def row(n: int) -> pd.DataFrame:
            some = kept.pop(n)
            return pd.DataFrame({"n_alleles": [n], "af": [np.concatenate([x for x, _ in some]).tobytes()], "gl": [np.concatenate([x for _, x in some]).tobytes()]})

        for b in batches:
            for n, af, flat in zip(b.n_alleles, b.af, b.flat, strict=True):
                kept.setdefault(n, []).append((np.asarray(af, float), np.asarray(flat, float)))
                if len(kept[n]) == size:
                    yield row(n)
        for n in list(kept):
            yield row(n)

    rows = sites.select(F.col("n_alleles").cast("int").alias("n_alleles"), "af", F.flatten(F.slice("gl", 1, used)).alias("flat"))
    return rows.mapInPandas(pack, "n_alleles int, af binary, gl binary")


def pair_sums(packed: DataFrame, used: int, x: np.ndarray, y: np.ndarray, z: np.ndarray, epsilon: float) -> DataFrame:
    """x, y and, summed over all sites, the columns ``SUMS`` at the weights z: a row for each unit and
    pair, which Spark adds up."""
    order = np.lexsort((y, x))
    x, y, z = x[order], y[order], z[order]
    firsts = np.flatnonzero(np.diff(x, prepend=-1))
    xs = x[firsts]
    spans = [(k, lo, min(lo + 128, b)) for k, (a, b) in enumerate(zip(firsts, [*firsts[1:], len(x)], strict=True)) for lo in range(a, b, 128)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, af, gl in zip(b.n_alleles, b.af, b.gl, strict=True):
                af = np.frombuffer(af).reshape(-1, n)
                model = model_tensor(af)
                lik, there = known(np.frombuffer(gl).reshape(len(af), used, -1))
                done, at = [], 0  # some thousand pairs go on at once
                for k, lo, hi in spans:
                    if k % HALVES == 0 and lo == firsts[k]:
                        half = half_sums(lik[:, xs[k : k + HALVES]], model)
                    p, both = np.matmul(lik[:, y[lo:hi]], half[:, k % HALVES]), there[:, xs[k], None] & there[:, y[lo:hi]]
                    count, f, g, h = solver.mixture_sums(p.transpose(1, 0, 2), both.T, z[lo:hi], epsilon)
                    done.append(np.column_stack([count, f, g, *(h[:, r, c] for r, c in UPPER)]))
                    if hi - at >= 4096 or hi == len(x):
                        yield pd.DataFrame(np.concatenate(done), columns=SUMS).assign(x=x[at:hi], y=y[at:hi])
                        done, at = [], hi

    rows = packed.mapInPandas(run, ", ".join(f"{c} double" for c in SUMS) + ", x int, y int")
    return rows.groupBy("x", "y").agg(*(F.sum(c).alias(c) for c in SUMS))


def advanced(states: DataFrame, sums: DataFrame, s: solver.Settings) -> DataFrame:
    """States after one step of each pair that is not done. One that shares no site gets status 3; which
    of several is reported does not depend on the task that ends first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            points = np.stack(b.points.to_numpy()).reshape(len(b), 3, 9) if len(b) else np.zeros((0, 3, 9))
            search = solver.Search(points[:, 2], s)
            search.x, search.y = points[:, 0].copy(), points[:, 1].copy()
            for name in search.NUMBERS:
                setattr(search, name, b[name].to_numpy().astype(getattr(search, name).dtype))
            rows, n = search.live, b.n.fillna(0).to_numpy()
            search.status[rows[n[rows] == 0]] = 3
            rows = search.live
            v = b[SUMS].to_numpy()[rows] / n[rows, None]
            h = np.zeros((len(rows), 9, 9))
            for k, (i, j) in enumerate(UPPER):
                h[:, i, j] = h[:, j, i] = v[:, 11 + k]
            search.advance(rows, v[:, 1], v[:, 2:11], h)
            points = np.stack([search.x, search.y, search.z], 1).reshape(len(b), 27)
            yield pd.DataFrame({"x": b.x, "y": b.y, "points": list(points), **{k: getattr(search, k).astype(float) for k in search.NUMBERS}})

    return states.join(sums, ["x", "y"], "left").mapInPandas(run, STATE)


def by_units(packed: DataFrame, used: int, s: solver.Settings, wave: int) -> DataFrame:
    """For many sites: a table of the pairs' states, and passes over the sites that each give value,
    gradient and Hessian of all pairs that are not done. Tasks grow with sites; a pair's sums are
    added up by Spark; what the driver sends out, the points of a wave's pairs, is bounded."""
    spark, out, low = packed.sparkSession, [], 0
    while low < used:
        high, pairs = low, 0
        while high < used and (high == low or pairs + used - high <= wave):
            pairs, high = pairs + used - high, high + 1
        own = F.col("x") == F.col("y")
        at = F.when(own, F.array(*map(F.lit, solver.start(True).tolist() * 3))).otherwise(F.array(*map(F.lit, solver.start(False).tolist() * 3)))
        fresh: dict[str, Column] = {n: F.lit(float({"f": "inf", "condition": "nan", "a": 1}.get(n, 0))) for n in solver.Search.NUMBERS}
        states = written(sample_pairs(spark, used).where((F.col("x") >= low) & (F.col("x") < high)).select("x", "y", at.alias("points"), *(c.alias(n) for n, c in fresh.items())), "states")
        while True:
            live = states.where("status IN (0, 3)").select("x", "y", "status", F.slice("points", 19, 9).alias("z")).toArrow()
            if not len(live):
                break
            lost = live["status"].to_numpy() == 3
            if lost.any():
                raise no_site(*min(zip(live["x"].to_numpy()[lost].tolist(), live["y"].to_numpy()[lost].tolist(), strict=True)))
            z = live["z"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 9)
            sums = pair_sums(packed, used, live["x"].to_numpy(), live["y"].to_numpy(), z, s.epsilon)
            old, states = states, written(advanced(states, sums, s), "states")
            discard(old)
        out.append(states)
        low = high
    rows = functools.reduce(DataFrame.unionByName, out)
    weights = [F.get("points", F.lit(k)).alias(d) for k, d in enumerate(D)]
    return rows.select("x", "y", *weights, F.col("iterations").cast("long").alias("iterations"), F.col("f").alias("objective"), "condition", (F.col("status") == 1).alias("converged"))


def relatedness_gl(sites: DataFrame, iterations: int = 100, samples: int | None = None, least: float | None = None, block: int = BLOCK, local: int = LOCAL, unit: int = UNIT, wave: int = WAVE) -> DataFrame:
    """Maximum likelihood from genotype likelihoods. sites: site_id, n_alleles, gl (array over
    samples of arrays), and af if it is given.

    Up to ``local`` sites each pair of sample blocks is a task of its own; beyond, pairs are
    solved by passes over units of ``unit`` sites. Both take the same steps for each pair."""
    n = sites.select(F.size("gl").alias("n")).first()
    if n is None:
        raise ValueError("no sites")
    n = n["n"]
    used = n if samples is None else samples
    if used > n:
        raise ValueError("more samples asked for than there are")
    few, s = sites.limit(local + 1).count() <= local, solver.Settings(outer=iterations)
    if "af" not in sites.columns:
        sites = estimate_frequencies(sites, iterations, carry=True)
        if not few:  # apart from the packing, so that a core has one Python process at a time and not two
            sites = written(sites, "frequencies")
    least = 1 / (2 * n) if least is None else least
    sites = reduce_sites(sites.select("site_id", "n_alleles", "gl", apply_threshold(F.col("af"), least).alias("af")))
    return finish(by_tile(sites, used, block, s) if few else by_units(written(units(sites, used, unit).repartition(sites.sparkSession.sparkContext.defaultParallelism), "units"), used, s, wave))
