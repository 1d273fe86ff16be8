"""Thinning, exact random subsets, sweeps over tracks and kinship by generations, against plain Python."""

import functools
import random
from collections import Counter

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from kinfold.operators import evaluate, selection

SITES = "chrom string, pos long, ref string"


def thinned(rows, distance):
    out = []
    for c in {r[0] for r in rows}:
        last = None
        for r in sorted(x for x in rows if x[0] == c):
            if last is None or r[1] - last >= distance:
                out.append(r)
                last = r[1]
    return sorted(out)


@pytest.mark.parametrize(("distance", "window"), [(1, 50), (7, 10), (40, 13), (100, 1000), (5000, 20), (33, None)])
def test_thinning_is_the_sequential_rule(spark, distance, window):
    r = random.Random(distance)
    rows = [(c, r.choice([r.randint(-50, 3000), r.randint(900, 960)]), r.choice("ACGT")) for c in "xxy" for _ in range(500)]
    df = spark.createDataFrame([*rows, *rows[:40], (None, 3, "A"), ("x", None, "A"), ("one", 5, "A")], SITES).repartition(6)
    got = sorted(tuple(x) for x in selection.thin(df, distance, window).collect())
    assert got == thinned([*rows, ("one", 5, "A")], distance)
    assert selection.thin(df.limit(0), distance, window).count() == 0


def test_thinning_by_no_distance(spark):
    df = spark.createDataFrame([("x", 1, "A"), ("x", 1, "A"), ("x", 2, "C"), (None, 2, "C")], SITES)
    assert selection.thin(df, 0).count() == 3


@pytest.mark.parametrize("bits", [3, 14])
def test_random_subset(spark, bits):
    rows = [("x", k, "A") for k in range(700)] + [("x", 5, "C")] * 60 + [("x", 6, None)] * 300
    df = spark.createDataFrame(rows, SITES).repartition(5)
    before: Counter = Counter()
    for k in (0, 1, 50, 400, 1000, 1059, 1060, 2000):
        got = Counter(tuple(x) for x in selection.random_subset(df, k, 9, bits).collect())
        assert sum(got.values()) == min(k, len(rows)) and got <= Counter(rows) and before <= got
        before = got
    key = selection.random_key(["chrom", "pos"], 9)
    want = {r["pos"] for r in df.where("pos < 700 AND ref = 'A'").orderBy(key).limit(20).collect()}
    few = selection.random_subset(df.where("ref = 'A'"), 20, 9, bits)
    assert {r["pos"] for r in few.collect()} == want == {r["pos"] for r in selection.random_subset(df.where("ref = 'A'").repartition(2), 20, 9).collect()}
    assert want != {r["pos"] for r in selection.random_subset(df.where("ref = 'A'"), 20, 10).collect()}


@pytest.mark.parametrize("window", [None, 7, 60])
def test_sweep(spark, window):
    r, length = random.Random(2), 200
    rows = [(r.choice([1, 2]), r.choice(evaluate.TRACKS), r.randint(-20, 210), r.randint(-20, 230)) for _ in range(60)] + [(1, "ij", None, 5), (1, "kl", 3, None)]
    df = spark.createDataFrame(rows + rows[:5], "pair long, track string, left long, right long")
    pairs = spark.createDataFrame([(1,), (2,), (3,), (3,)], "pair long")
    spans = evaluate.joint_spans(df, pairs, length, window).collect()
    inside = lambda p, t, at: any(x[0] == p and x[1] == t and x[2] is not None and x[3] is not None and x[2] <= at < x[3] for x in rows)
    for p in (1, 2, 3):
        own = sorted((x for x in spans if x["pair"] == p), key=lambda x: x["left"])
        assert own[0]["left"] == 0 and own[-1]["right"] == length and all(a["right"] == b["left"] for a, b in zip(own, own[1:]))
        for x in own:
            assert all(inside(p, t, at) == x[t] for t in evaluate.TRACKS for at in range(x["left"], x["right"]))
    states = {x["pair"]: x for x in evaluate.states_of_tracks(df, pairs, length, window).collect()}
    assert states[3]["d9"] == 1 and all(abs(sum(x[f"d{k}"] for k in range(1, 10)) - 1) < 1e-9 for x in states.values())


def test_catalogue_by_generations(spark):
    """The expected kinship of all ten entries comes out of their families."""
    got = {r["relationship"]: r["expected_kinship"] for r in evaluate.focal_kinship(spark).collect()}
    assert {k: got[k] for k in evaluate.CATALOGUE} == evaluate.CATALOGUE
    assert (got["inbred_full_sib"], got["inbred_half_sib"], got["inbred_first_cousin"], got["inbred_unrelated"]) == (0.375, 0.3125, 0.25, 0.0)
    with pytest.raises(ValueError, match="no relationship cousin; there are first_cousin, full_sib"):
        evaluate.pedigree(spark, relationships=("cousin",))


def test_kinship_of_a_random_pedigree(spark):
    r, up = random.Random(4), {}
    for k in range(40):
        some = list(up)
        up[k] = (r.choice([None, *some]), r.choice([None, *some])) if k > 3 else (None, None)

    def phi(i, j):
        if i is None or j is None:
            return 0.0
        if i == j:
            return 0.5 + phi(*up[i]) / 2
        i, j = min(i, j), max(i, j)
        return (phi(up[j][0], i) + phi(up[j][1], i)) / 2

    df = spark.createDataFrame([(f, k, a, b) for f in "xy" for k, (a, b) in up.items()], "family string, ind long, parent1 long, parent2 long")
    got = {(x["family"], x["a"], x["b"]): x["kinship"] for x in evaluate.expected_kinship(df, ["family"]).collect()}
    want = {(f, i, j): phi(i, j) for f in "xy" for i in up for j in up if i <= j and phi(i, j) > 0}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    loop = spark.createDataFrame([(1, 2, None), (2, 1, None)], "ind long, parent1 long, parent2 long")
    mocked, evaluate.MOST_GENERATIONS = evaluate.MOST_GENERATIONS, 5
    try:
        with pytest.raises(ValueError, match="loop"):
            evaluate.expected_kinship(loop, [])
    finally:
        evaluate.MOST_GENERATIONS = mocked


def test_kinship_broadcasts_no_table_that_grows(spark, monkeypatch):
    """Written tables look small to the planner; blocks of a family give the same as the whole."""
    plans, written = [], evaluate.written
    monkeypatch.setattr(evaluate, "written", lambda df, what: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, what))
    df = spark.createDataFrame([(f, k, k // 2 if k > 3 else None, k // 3 if k > 3 else None) for f in "xy" for k in range(30)], "family string, ind long, parent1 long, parent2 long")
    whole, cut = ({(r["family"], r["a"], r["b"]): r["kinship"] for r in evaluate.expected_kinship(df, ["family"], block).collect()} for block in (512, 4))
    assert whole == cut and len(whole) > 600 and whole["x", 4, 5] == 0.25
    one = evaluate.expected_kinship(df.where("family = 'x'").drop("family"), [], 7).collect()
    assert {("x", r["a"], r["b"]): r["kinship"] for r in one} == {k: v for k, v in whole.items() if k[0] == "x"}
    assert plans and not any("Broadcast" in p for p in plans)


def shuffled(spark) -> int:
    """Rows that all stages so far have written for others to read."""
    gateway = spark.sparkContext._gateway
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_kinship_shuffles_people_not_blocks(spark, monkeypatch):
    """Rows shuffled and written follow from the people, however many blocks a family is cut into; a family dealt to several tasks
    goes to each of them once, and gives the same."""
    kept, written = [], evaluate.written
    monkeypatch.setattr(evaluate, "written", lambda df, what: kept.append(written(df, what)) or kept[-1])
    df = spark.createDataFrame([(f, k, k // 2 if k > 3 else None, k // 3 if k > 3 else None) for f in "xy" for k in range(400)], "family string, ind long, parent1 long, parent2 long")

    def run():
        before, found = shuffled(spark), {(r["family"], r["a"], r["b"]): r["kinship"] for r in evaluate.expected_kinship(df, ["family"], 4).collect()}
        return found, shuffled(spark) - before

    whole, rows = run()
    assert len(whole) > 150_000 and 0 < rows < 2.1 * 800 and sum(t.count() for t in kept) == 800
    for name, value in (("PAIRS", 1), ("TASKS", 6), ("CELLS", 2000), ("ROWS", 50)):  # three tasks a family
        monkeypatch.setattr(evaluate, name, value)
    cut, rows = run()
    assert cut == whole and rows < 4.1 * 800


def test_kinship_of_odd_pedigrees(spark, monkeypatch):
    """Names that are no numbers, parents without a row, a parent twice, children numbered before their parents, unrelated people."""
    r, up, names = random.Random(5), {}, [f"{'é' if k % 7 else ''}{k}" for k in range(60)]
    random.Random(6).shuffle(names)
    for k, name in enumerate(names):
        some = [names[r.randrange(k)] if k > 5 else None, *r.choices([*names[:k], "no one", None], k=2)]
        up[name] = (some[1], some[1]) if k % 9 == 8 else (some[0], some[2])
    place = {name: k for k, name in enumerate(names)}

    @functools.cache
    def phi(i, j):
        if i not in up or j not in up:
            return 0.0
        if i == j:
            return 0.5 + phi(*up[i]) / 2
        i, j = sorted((i, j), key=place.get)
        return (phi(up[j][0], i) + phi(up[j][1], i)) / 2

    df = spark.createDataFrame([(1, n, *up[n]) for n in sorted(names)] + [(1, None, None, None), (2, "a", None, None)], "f int, ind string, parent1 string, parent2 string")
    want = {(1, i, j): phi(i, j) for i in up for j in up if i <= j and phi(i, j) > 0} | {(2, "a", "a"): 0.5}
    assert 200 < len(want) < 1830
    for tasks in (1, 5):
        monkeypatch.setattr(evaluate, "PAIRS", 2000 // tasks)
        rows = evaluate.expected_kinship(df, ["f"], 7).collect()
        got = {(x["f"], x["a"], x["b"]): x["kinship"] for x in rows}
        assert len(rows) == len(got) and got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    with pytest.raises(PythonException, match="an individual is there twice in a family"):
        evaluate.expected_kinship(df.unionByName(df.limit(1)), ["f"])


def test_references_seeds_comparator_and_sidecar(spark):
    rows = evaluate.pedigree(spark, 2, references=3, relationships=("full_sib",)).collect()
    assert Counter((r["rep"], r["family"]) for r in rows) == {(0, "full_sib"): 4, (0, "reference"): 3, (1, "full_sib"): 4, (1, "reference"): 3}
    seeds = [r["seed"] for r in evaluate.seeds(spark.range(4).withColumnRenamed("id", "rep"), 1).collect()]
    assert len(set(seeds)) == 4 and seeds == [r["seed"] for r in evaluate.seeds(spark.range(4).withColumnRenamed("id", "rep"), 1).collect()]
    nine = ", ".join(f"d{k} double" for k in range(1, 10))
    found = spark.createDataFrame([(0, 1, *[1.0] * 9), (0, 2, *[2.0] * 9), (14, 15, *[3.0] * 9)], f"a int, b int, {nine}")
    assert {r["rel"]: r["d1"] for r in evaluate.comparator_scores(found).collect()} == {"ifs": 1.0, "our": 3.0}
    side = evaluate.pair_sidecar(spark.createDataFrame([(1, 0.2500001)], "rep int, kinship double"), "full_sib", 0.25).first()
    assert tuple(side) == (1, "full_sib", "full_sib_r1_a", "full_sib_r1_b", 0.25, 0.25)


def test_loops_of_no_one(spark):
    none = spark.createDataFrame([], "family string, ind long, parent1 long, parent2 long")
    assert evaluate.expected_kinship(none, ["family"]).count() == 0
    assert evaluate.joint_spans(spark.createDataFrame([], "pair long, track string, left long, right long"), none.select(F.col("ind").alias("pair")), 10).count() == 0
