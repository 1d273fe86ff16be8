"""Identity model, solvers, decoding and recovery of planted relationships."""

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kinfold.functions import solver
from kinfold.functions.identity import joint_genotypes, mirror
from kinfold.operators import evaluate, pairs, sites
from kinfold.plans import panel, queries, relatedness
from kinfold.sources import tables, vcf

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("af", [[0.3, 0.7], [0.2, 0.3, 0.5], [0.1, 0.2, 0.3, 0.4]])
def test_model_sums_to_one(af):
    assert np.allclose(relatedness.model_tensor(np.array([af])).sum((1, 2)), 1)


def test_modes(spark):
    rows = joint_genotypes(spark).collect()
    assert len(rows) == 145
    assert [(r["n_alleles"], r["gx"], r["gy"], r["mode"]) for r in rows] == [(a, x, y, m) for a, t in relatedness.mode_tables().items() for x, y, _, m in t]


def test_mirror():
    assert mirror(mirror(list(range(9)))) == list(range(9))


def test_quadratic_is_the_best_support():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a = rng.normal(size=(12, 5))
        q, c = a.T @ a / 12 + 0.01 * np.eye(5), rng.normal(size=5)
        y, _, done = solver.quadratic(q, c, np.full(5, 0.2), 100)
        best = np.inf
        for n in range(1, 6):
            for f in itertools.combinations(range(5), n):
                k = np.zeros((n + 1, n + 1))
                k[:n, :n], k[n, :n], k[:n, n] = q[np.ix_(f, f)], 1, 1
                z = np.linalg.solve(k, [*-c[list(f)], 1])[:n]
                if (z >= -1e-12).all():
                    best = min(best, 0.5 * z @ q[np.ix_(f, f)] @ z + c[list(f)] @ z)
        assert done and abs(0.5 * y @ q @ y + c @ y - best) < 1e-9


def test_mixture_against_em():
    rng = np.random.default_rng(1)
    p = rng.random((400, 9)) ** 3
    r = solver.mixture(p, solver.start(False))
    d = np.full(9, 1 / 9)
    for _ in range(20_000):
        w = p * d
        d = (w / w.sum(1, keepdims=True)).mean(0)
    assert r.converged and abs(r.objective + np.log(p @ d).mean()) < 1e-5 and abs(r.x.sum() - 1) < 1e-9 and (r.x >= 0).all()


def test_planted_relationships(spark):
    for found in (relatedness.relatedness_gt(panel.sites(spark, SF)), relatedness.relatedness_gl(panel.likelihoods(spark, SF))):
        rows = found.collect()
        assert len(rows) == 528 and all(abs(sum(r[f"d{k}"] for k in range(1, 10)) - 1) < 1e-6 for r in rows)
        other = sorted((r for r in rows if r["x"] < r["y"]), key=lambda r: -r["kinship"])
        assert (other[0]["x"], other[0]["y"]) == (0, 1) and other[0]["kinship"] > 0.15
        assert max((r for r in rows if r["x"] == r["y"]), key=lambda r: r["kinship"])["x"] == 4


VCF = """##fileformat=VCFv4.2
##INFO=<ID=AF,Number=A,Type=Float,Description="">
##FORMAT=<ID=GT,Number=1,Type=String,Description="">
##FORMAT=<ID=PL,Number=G,Type=Integer,Description="">
##FORMAT=<ID=GL,Number=G,Type=Float,Description="">
#CHROM	POS	ID	REF	ALT	QUAL	FILTER	INFO	FORMAT	a	b
1	10	.	a	C	.	.	AF=0.25	GT:PL:GL	0/1:0,10,20:0,-1,-2	1|1:20,10,0:-2,.,0
1	20	.	A	C,G	.	.	AF=0.7,0.6	GT:PL:GL	0/2:0,1,2,3,4,5:0,-1,-2,-3,-4,-5	1/2:0,1,2,3,4,5:0,-1,-2,-3,-4,-5
1	30	.	AT	C	.	.	AF=0.1	GT	0/0	0/0
1	40	.	A	N	.	.	AF=0.1	GT	0/0	0/0
1	50	.	A	C	.	.	AF=0.1	GT:PL:GL	./1:0,1,2:0,-1,-2	0/0:0,1,2:0,-1,-2
"""


def test_vcf(spark, tmp_path):
    path = tmp_path / "x.vcf"
    path.write_text(VCF)
    got = vcf.read_gt(spark, str(path), with_af=True)
    rows = got.sites.orderBy("pos").collect()
    assert vcf.samples(spark, str(path)) == ["a", "b"] and [r["pos"] for r in rows] == [10, 20]
    assert rows[0]["lo"] == [0, 1] and rows[0]["hi"] == [1, 1] and rows[0]["af"] == [0.75, 0.25] and rows[1]["af"][0] == 0.0
    assert {r["status"]: r["n_sites"] for r in got.counters.groupBy("status").agg(F.sum("n_sites").alias("n_sites")).collect()} == {"kept": 2, "not_snp": 2, "missing": 1}
    gl = vcf.read_likelihoods(spark, str(path), "GL").sites.orderBy("pos").collect()
    assert len(gl) == 3 and np.isnan(gl[0]["gl"][1][1]) and abs(gl[0]["gl"][0][1] - 0.1) < 1e-9
    out = str(tmp_path / "out.tsv")
    tables.write_results(relatedness.relatedness_gt(got.sites.drop("af")), vcf.samples(spark, str(path)), out)
    back = tables.read_estimates(spark, out)
    assert back.count() == 3 and back.columns[:3] == ["sample1", "sample2", "kinship"]
    bad = tmp_path / "bad.vcf"
    bad.write_text(VCF.replace("0/1:0,10,20", "0:0,10,20"))
    with pytest.raises(Exception, match="diploid"):
        vcf.read_gt(spark, str(bad)).sites.collect()


def test_equal_records_count_each(spark):
    """Two equal sites weigh as much as one site given twice under other ids."""
    some = panel.likelihoods(spark, SF).drop("af").where("site_id < 60").select("site_id", "n_alleles", "gl")
    kept = {}
    for name, shift in (("equal", 0), ("other", 1000)):
        twice = some.unionByName(some.where("site_id < 5").withColumn("site_id", F.col("site_id") + shift))
        kept[name] = {(r["x"], r["y"]): r["objective"] for r in relatedness.relatedness_gl(twice, samples=3).collect()}
    assert len(kept["equal"]) == 6 and all(abs(kept["equal"][k] - v) < 1e-9 for k, v in kept["other"].items())


def test_nan_is_no_frequency(spark):
    df = spark.createDataFrame([(1, 3, [0.5, float("nan"), 0.5])], "site_id long, n_alleles int, af array<double>")
    assert sites.reduce_sites(df).first()["af"] == [0.5, 0.5]


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("genotype_index", "pair_enumeration", "joint_genotype_modes", "thinned_sites", "random_subset", "ibd_states_of_tracks", "expected_kinship", "complete_and_varied_sites", "panel_frequencies", "scoring_table", "top_pairs_by_name", "kinship_described", "focal_names", "snp_site_filter", "genotype_counts", "allele_frequency_gt", "pair_linear_term", "quadratic_matrix", "jacquard_nll_uniform", "zero_freq_reduction", "ibd_mode_spans", "mirror_pairs"):
        want, got = con.execute(queries.ORACLE_SQL[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
        columns = sorted(want.columns)
        assert columns == sorted(got.columns) and sorted(map(tuple, want[columns].values.tolist())) == sorted(map(tuple, got[columns].values.tolist())), name


@pytest.mark.parametrize("name", ["mixture_biallelic", "mixture_multiallelic", "jacquard_nll_uniform", "jacquard_gradient_uniform", "jacquard_hessian_uniform", "nan_pair_filter"])
def test_all_pairs(spark, name):
    """All 528 pairs, as by the SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    sql = queries.ORACLE_SQL[name]
    assert "sample_id <" not in sql.replace("sample_id <= y", "")
    want, got = con.execute(sql).df(), queries.QUERIES[name](spark, SF).toPandas()
    keys = [c for c in ("site_id", "x", "y") if c in want.columns]
    want, got = (t.sort_values(keys).reset_index(drop=True) for t in (want, got[want.columns]))
    assert len(got[["x", "y"]].drop_duplicates()) == 528 and want[keys].astype(int).equals(got[keys].astype(int))
    assert np.allclose(want, got, rtol=0, atol=2e-6)


def test_component_likelihoods_row_by_row(spark):
    """Against sums over all pairs of genotypes; made in numpy for many sites at once, not in lambdas for each pair."""
    r, nan = np.random.default_rng(3), float("nan")
    made = [(k, a := 2 + k % 3, r.dirichlet([1] * a).tolist(), [[nan] * (a * (a + 1) // 2) if (k + q) % 4 == 0 else r.random(a * (a + 1) // 2).tolist() for q in range(4 - k % 2)]) for k in range(9)]
    df = spark.createDataFrame(made, "site_id long, n_alleles int, af array<double>, gl array<array<double>>")
    rows = pairs.mixture_rows(df)
    got = {(x["site_id"], x["x"], x["y"]): [x[f"m{k}"] for k in range(1, 10)] for x in rows.collect()}
    want = {}
    for k, _, af, gl in made:
        model = relatedness.model_tensor(np.array([af]))[0]
        want |= {(k, x, y): np.einsum("g,h,ghs->s", gl[x], gl[y], model) for x in range(len(gl)) for y in range(x, len(gl)) if not np.isnan(gl[x] + gl[y]).any()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], v, rtol=0, atol=1e-12) for k, v in want.items())
    assert {(x["x"], x["y"]) for x in pairs.mixture_rows(df, 2).collect()} == {(0, 0), (0, 1), (1, 1)}
    assert "zip_with" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_given_frequencies_solves_all_pairs(spark):
    rows = queries.QUERIES["relatedness_gl_given_frequencies"](spark, SF).collect()
    assert sorted((r["x"], r["y"]) for r in rows) == list(itertools.combinations_with_replacement(range(panel.SAMPLES), 2))
    few = relatedness.relatedness_gl(panel.likelihoods(spark, SF, "GL"), samples=8).collect()
    want = {(r["x"], r["y"]): r["kinship"] for r in rows if r["y"] < 8}
    assert len(few) == 36 and all(abs(r["kinship"] - want[r["x"], r["y"]]) < 1e-6 for r in few)


def test_inbred_families(spark):
    """Kinship of the focal pairs, and of each with itself, by recursion over the pedigree."""
    rows = evaluate.pedigree(spark).collect()
    for family, pair, own in (("inbred_full_sib", 0.375, 0.625), ("inbred_half_sib", 0.3125, 0.625), ("inbred_first_cousin", 0.25, 0.625), ("inbred_unrelated", 0.0, 0.625)):
        up = {r["ind"]: [p for p in (r["parent1"], r["parent2"]) if p] for r in rows if r["family"] == family}
        age = lambda i: 1 + max(map(age, up[i]), default=0)  # noqa: B023, E731

        def phi(i, j):
            if i == j:
                return 0.5 + (phi(*up[i]) / 2 if up[i] else 0)  # noqa: B023
            i, j = sorted((i, j), key=age)  # noqa: B023
            return sum(phi(p, i) for p in up[j]) / 2  # noqa: B023

        a, b = evaluate.FAMILIES[family][1]
        assert (phi(a, b), phi(a, a), phi(b, b)) == (pair, own, own), family


def test_frequency_column(spark, tmp_path):
    path = tmp_path / "maf.txt"
    path.write_text("chromo  position\tknownEM nInd\n 1 10  0.25 5\n1\t20\tnan 5\n\n1 30\n1 40 x 5\n")
    got = [r["knownEM"] for r in tables.read_frequencies(spark, str(path)).collect()]
    assert got[0] == 0.25 and np.isnan(got[1]) and got[2:] == [None, None]
    with pytest.raises(ValueError, match="no column other"):
        tables.read_frequencies(spark, str(path), "other")
    path.write_text("")
    assert tables.read_frequencies(spark, str(path)).count() == 0


def test_truth_table(spark, tmp_path):
    rows = [("full_sib", *[0.0] * 6, 0.25, 0.5, 0.25), ("unrelated", *[0.0] * 8, 1.0)]
    tables.write_truth(spark.createDataFrame(rows, "rel string, " + ", ".join(f"d{k} double" for k in range(1, 10))), str(tmp_path / "ibd"))
    back = {r["rel"]: r for r in tables.read_truth(spark, str(tmp_path / "ibd")).collect()}
    assert back["full_sib"]["kinship"] == 0.25 and back["full_sib"]["jacquard8"] == 0.5 and back["unrelated"]["kinship"] == 0 and len(back) == 2


def test_panel_of_gaps(spark):
    rows = [(0, [0, 1, 1, -1]), (1, [0, 1, 1, 1]), (2, [1, 1, 1, 1]), (3, [None, None, -1, -1]), (4, []), (5, [0, None, 1, 2])]
    df = spark.createDataFrame(rows, "site_id long, a array<int>")
    got = df.select("site_id", sites.complete_and_varied(F.col("a"), 4).alias("fine"), sites.panel_frequencies(F.lit(3), F.col("a")).alias("af")).orderBy("site_id").collect()
    assert [r["fine"] for r in got] == [False, True, False, False, False, False]
    assert [[round(x, 6) for x in r["af"]] for r in got] == [[0.333333, 0.666667, 0], [0.25, 0.75, 0], [0, 1, 0], [0, 0, 0], [0, 0, 0], [0.333333] * 3]


def test_scores_of_no_records(spark):
    none = spark.createDataFrame([], "rep string, depth int, rel string, " + ", ".join(f"d{k} double" for k in range(1, 10)))
    scored = evaluate.scoring_table({"a": none}, none.drop("depth"))
    assert scored.count() == 0
    means = evaluate.score_means(scored, "a", "jac_tvd", ["y", "x"]).collect()
    assert [(r["rank"], r["rel"]) for r in means] == [(0, "y"), (1, "x")]
    assert evaluate.described(scored).first()["n"] == 0


def test_long_header(spark, tmp_path):
    path = tmp_path / "long.vcf"
    path.write_text(VCF.replace("#CHROM", "##x=1\n" * 3000 + "#CHROM"))
    assert vcf.samples(spark, str(path)) == ["a", "b"] and len(vcf.header(spark, str(path))) == 3006


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 528
