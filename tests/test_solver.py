"""Batches of small problems against one at a time, and pairs by passes over units of sites."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions import solver
from kinfold.functions.components import component_rows, half_sums, known, model_tensor
from kinfold.operators import pairs
from kinfold.plans import panel, queries, relatedness

SF = "/root/testdata/sf0.001"


def one_by_one(q, c, y):
    """The active set for one problem, with numpy's own solver."""
    y, free = y.copy(), y > 0
    for k in range(200):
        g, f = q @ y + c, np.flatnonzero(free)
        both = np.linalg.solve(q[np.ix_(f, f)], np.stack([g[f], np.ones(len(f))], 1))
        rate = both[:, 0].sum() / both[:, 1].sum()
        p = np.zeros_like(y)
        p[f] = rate * both[:, 1] - both[:, 0]
        if np.abs(p).max() <= 1e-12:
            held = np.where(free, np.inf, g - rate)
            if held.min() >= -1e-10:
                return y, k
            free[held.argmin()] = True
            continue
        limit = np.array([-y[i] / p[i] if p[i] < 0 else np.inf for i in range(len(y))])
        stop = limit.argmin()
        y = np.maximum(y + min(1.0, limit[stop]) * p, 0)
        if limit[stop] < 1:
            y[stop], free[stop] = 0.0, False
    raise AssertionError


def test_batches_are_single_problems():
    r = np.random.default_rng(4)
    a, c, y = r.normal(size=(400, 14, 9)), r.normal(size=(400, 9)), r.dirichlet(np.ones(9), 400)
    y[::3, :4] = 0
    y /= y.sum(1, keepdims=True)
    q = np.einsum("mki,mkj->mij", a, a) / 14 + 0.01 * np.eye(9)
    got, steps, done = solver.quadratics(q, c, y, 200)
    want = [one_by_one(*x) for x in zip(q, c, y, strict=True)]
    assert done.all() and np.allclose(got, [w for w, _ in want], rtol=0, atol=1e-11) and steps.tolist() == [k for _, k in want]
    few, steps, done = solver.quadratics(q, c, y, 2)
    assert (steps[~done] == 2).all() and not done.all() and np.allclose(few.sum(1), 1)


def test_factors():
    r = np.random.default_rng(6)
    a = r.normal(size=(300, 6, 12))
    fine, free = a @ a.transpose(0, 2, 1) + 0.1 * np.eye(6), r.random((300, 6)) < 0.7
    low, d = solver.factors(fine, free)
    back = np.einsum("mij,mj,mkj->mik", low, d, low)
    both = free[:, :, None] & free[:, None, :]
    assert np.allclose(back, np.where(both, fine, 0) + np.eye(6) * ~free[:, None])
    b = r.normal(size=(300, 6, 2))
    assert np.allclose(back @ solver.solve(low, d, b), b)
    wild = a[:, :, :6] + a[:, :, :6].transpose(0, 2, 1)
    wild[:5] = 0
    low, d = solver.factors(wild, free)  # raised until positive, and unchanged but on the diagonal
    changed = np.einsum("mij,mj,mkj->mik", low, d, low) - np.where(both, wild, 0)
    assert (d > 0).all() and np.allclose(changed * ~np.eye(6, dtype=bool), 0, atol=1e-8) and (np.einsum("mii->mi", changed) > -1e-9).all()


def test_frequencies_by_expectation():
    r = np.random.default_rng(2)
    lik, there = r.random((40, 30, 3, 3)) ** 4, r.random((40, 30)) < 0.8
    lik += lik.transpose(0, 1, 3, 2)
    found = solver.frequencies(lik, there)
    for m in range(40):
        own, x = lik[m][there[m]], np.full(3, 1 / 3)
        for _ in range(3000):
            w = own * x[:, None] * x
            x = (w / w.sum((1, 2), keepdims=True)).sum(2).mean(0)
        f = -np.log(np.einsum("kij,i,j->k", own, x, x)).mean()
        assert found.converged[m] and abs(found.f[m] - f) < 1e-6 and abs(found.x[m].sum() - 1) < 1e-9


@pytest.mark.parametrize("wave", [60, 100_000])
def test_passes_are_tiles(spark, wave):
    """Passes over units of sites, in waves of pairs, take the steps that tiles take."""
    lik = panel.likelihoods(spark, SF, "GL").where("site_id < 200")
    rows = {}
    for name, how in (("tiles", {"block": 5}), ("passes", {"local": 0, "unit": 30, "wave": wave})):
        rows[name] = {(r["x"], r["y"]): r for r in relatedness.relatedness_gl(lik, samples=12, **how).collect()}
    assert len(rows["tiles"]) == 78 and rows["tiles"].keys() == rows["passes"].keys()
    for k, a in rows["tiles"].items():
        b = rows["passes"][k]
        assert a["converged"] and b["converged"] and abs(a["objective"] - b["objective"]) < 1e-9 and abs(a["kinship"] - b["kinship"]) < 1e-6
        assert all(abs(a[f"d{i}"] - b[f"d{i}"]) < 1e-6 for i in range(1, 10))


@pytest.mark.parametrize("local", [0, 4096])
def test_pairs_without_a_site(spark, local):
    nan, one = [float("nan")] * 3, [1.0, 0.5, 0.1]
    rows = spark.createDataFrame([(0, 2, [0.5, 0.5], [one, one, nan]), (1, 2, [0.5, 0.5], [nan, one, one])], "site_id long, n_alleles int, af array<double>, gl array<array<double>>")
    with pytest.raises(Exception, match="samples 0 and 2 share no site"):
        relatedness.relatedness_gl(rows, local=local).collect()
    assert relatedness.relatedness_gl(rows, samples=2, local=local).count() == 3
    flat = spark.createDataFrame([(0, 2, [1.0, 0.0], [one, one])], rows.schema)
    with pytest.raises(Exception, match="samples 0 and 0 share no site"):  # none is left
        relatedness.relatedness_gl(flat, local=local).collect()


def test_first_pair_without_a_site_is_named(spark):
    """Also where tasks of other pairs end first."""
    nan, one = [float("nan")] * 3, [1.0, 0.5, 0.1]
    rows = spark.createDataFrame([(k, 2, [0.5, 0.5], [nan if k in (2 * s % 7, 5) else one for s in range(12)]) for k in range(7)], "site_id long, n_alleles int, af array<double>, gl array<array<double>>")
    flat = rows.withColumn("af", F.array(F.lit(1.0), F.lit(0.0)))
    with pytest.raises(ValueError, match="samples 0 and 0 share no site"):
        relatedness.relatedness_gl(flat, local=0).collect()
    late = rows.where("site_id IN (4, 6)")  # samples 2 and 9 lack one, 3 and 10 the other
    with pytest.raises(ValueError, match="samples 2 and 3 share no site"):
        relatedness.relatedness_gl(late, local=0).collect()


def test_passes_stop_at_the_limit(spark):
    lik = panel.likelihoods(spark, SF, "GL").where("site_id < 100")
    rows = relatedness.relatedness_gl(lik, iterations=1, samples=4, local=0).collect()
    assert len(rows) == 10 and any(not r["converged"] and r["iterations"] == 1 and np.isnan(r["condition"]) for r in rows)


def test_sites_without_data(spark):
    nan = [float("nan")] * 3
    rows = spark.createDataFrame([(7, 2, [nan, nan])], "site_id long, n_alleles int, gl array<array<double>>")
    with pytest.raises(Exception, match="no sample has data at site 7"):
        relatedness.estimate_frequencies(rows).collect()
    assert relatedness.estimate_frequencies(rows.where(F.lit(False)), carry=True).columns == ["site_id", "af", "af_iterations", "af_objective", "af_converged", "n_alleles", "gl"]


def test_frequencies_of_a_rare_allele(spark, tmp_path):
    """Where 60 rounds are short of the maximum the query still has what its SQL has; the solver has
    the maximum, which many rounds come to."""
    codes = "0221121211001232013102021201202021103310001003201130101122101102"
    vectors = spark.createDataFrame([(43360, [(int(c) + 0.5) * 0.375 / 4 - 0.1875 for c in codes], 2)], "vec_id long, embedding array<float>, label int")
    vectors.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    site = panel.likelihoods(spark, str(tmp_path))
    best = relatedness.estimate_frequencies(site).first()["af"]
    short, long = (relatedness.frequencies_by_rounds(site, n).first()["af"] for n in (60, 2000))
    assert max(abs(a - b) for a, b in zip(best, long)) < 1e-6 and max(abs(a - b) for a, b in zip(best, short)) > 1e-4
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["allele_frequency_mle"]).fetchall())
    assert len(want) == 4 and sorted(map(tuple, queries.QUERIES["allele_frequency_mle"](spark, str(tmp_path)).collect())) == want


def test_packing_has_one_python_stage(spark, monkeypatch):
    """Estimates and units aren't made in one stage, where each core would have two Python processes."""
    plans, written = {}, relatedness.written
    monkeypatch.setattr(relatedness, "written", lambda df, what: plans.setdefault(what, df._jdf.queryExecution().optimizedPlan().toString()) and written(df, what))
    lik = panel.likelihoods(spark, SF).drop("af").where("site_id < 60")
    assert relatedness.relatedness_gl(lik, samples=3, local=0).count() == 6
    assert plans["units"].count("MapInPandas") == 1 and plans["frequencies"].count("MapInPandas") == 1


def test_half_sums_serve_all_samples(spark):
    """One product for up to 32 samples gives what each sample alone gives, also beyond 32 and for some
    of the pairs only."""
    r = np.random.default_rng(3)
    lik, af = r.random((5, 40, 6)), r.dirichlet(np.ones(3), 5)
    lik[r.random((5, 40)) < 0.2, 0] = np.nan
    model = model_tensor(af)
    own, there = known(lik)
    half = half_sums(own, model)
    for x in range(40):
        want, both = component_rows(lik[:, x], lik, model)
        assert np.allclose(np.matmul(own, half[:, x]).transpose(1, 0, 2), want, rtol=1e-12) and (both == (there[:, x, None] & there).T).all()
    sites = spark.createDataFrame([(v, 3, af[v].tolist(), lik[v].tolist()) for v in range(5)], "site_id long, n_alleles int, af array<double>, gl array<array<double>>")
    rows = {(q["site_id"], q["x"], q["y"]): [q[m] for m in pairs.M] for q in pairs.mixture_rows(sites).collect()}
    assert len(rows) == sum(n * (n + 1) // 2 for n in there.sum(1))
    assert all(np.allclose(m, component_rows(lik[:, x], lik[:, [y]], model)[0][0, v], rtol=1e-12) for (v, x, y), m in rows.items())
    some = np.array([(x, y) for x in range(40) for y in range(x, 40) if x != 7 and (x + y) % 3])
    z = r.dirichlet(np.ones(9), len(some))
    got = {(q["x"], q["y"]): q for q in relatedness.pair_sums(relatedness.units(sites, 40, 2), 40, some[:, 0], some[:, 1], z, 1e-8).collect()}
    assert len(got) == len(some)
    for (x, y), w in zip(some.tolist(), z, strict=True):
        n, f, g, h = solver.mixture_sums(*component_rows(lik[:, x], lik[:, [y]], model), w[None], 1e-8)
        q = got[x, y]
        assert q["n"] == n[0] and np.allclose([q["value"], *(q[f"g{k}"] for k in range(9))], [f[0], *g[0]]) and np.allclose([q[f"h{a}{b}"] for a, b in relatedness.UPPER], [h[0, a, b] for a, b in relatedness.UPPER])


def test_slopes_are_grouped_by_pair_alone(spark):
    """A row of a site and pair is neither exploded nor hashed by the pair's nine coefficients."""
    plan = queries.QUERIES["relatedness_gl_optimality"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    sums = [line[line.index("Aggregate [") :] for line in plan.splitlines() if "Aggregate [" in line and "avg(" in line]
    assert len(sums) == 1 and sums[0][: sums[0].index("]")].count("#") == 2 and "MapInArrow" in plan
    assert "Generate" not in plan[plan.index("Aggregate [") : plan.index("MapInArrow")]
