"""Merkle manifest, exact dedup and clustering against plain Python, on small tables with nulls,
empty and long texts, ties, repeated rows, empty tables and further columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import clustering, exact_dedup, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, run string, key string"
h = lambda s: hashlib.sha256(s.encode()).hexdigest()


def documents(spark, n: int, seed: int):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        text = r.choice([None, "", " ", "  ", "a\nb", "a b", "a\t \x0bb", "é\n\nü", "日本\n", f"text {k % 7}\nof {k % 3}", "a b", "x\ny" * 5000])
        rows.append((r.choice([None, k, k // 2, k // 5]), text, r.choice([None, "en", ""]), r.choice([None, "", "s1", "s1", "s1", "é", "Z"]), r.choice([None, k]), 7, "clash", "clash"))
    return spark.createDataFrame(rows + rows[: n // 10], SCHEMA).repartition(7), rows + rows[: n // 10]


def leaf_of(doc_id, text, lang, source, n_chars):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(level):
    """Levels from the leaves up to a single node."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def steps(levels, i):
    for level in levels[:-1]:
        run = level[i // 3 * 3 : i // 3 * 3 + 3]
        yield "".join(run[: i % 3]), "".join(run[i % 3 + 1 :])
        i //= 3


def manifest(rows):
    groups = defaultdict(list)
    for d, t, lang, s, n, *_ in rows:
        bare = t.replace("\n", "") if t is not None and d is not None and zlib.crc32(str(d).encode()) % 2 == 0 else t
        groups[s].append((d is not None, d or 0, leaf_of(d, t, lang, s, n), leaf_of(d, bare, lang, s, n), d))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, leaf, changed, d) in enumerate(sorted(groups[s])):
            path = [*steps(trees[s], i), *steps(top, k)]
            for a, b in path:
                changed = h(a + changed + b)
            out.append((d, leaf, trees[s][-1][0], top[-1][0], h("".join(a + b for a, b in path)), changed, changed == top[-1][0]))
    return Counter(out)


@pytest.mark.parametrize("n", [1, 3, 40, 900])
def test_manifest(spark, n):
    docs, rows = documents(spark, n, n)
    assert Counter(tuple(r) for r in merkle.merkle_manifest(docs).collect()) == manifest(rows)


def test_manifest_of_one_source(spark):
    """More than a block of leaves below a lone subroot; and no rows at all."""
    rows = [(k, f"t{k}", "en", "s", k, 0, "", "") for k in range(300)]
    got = merkle.merkle_manifest(spark.createDataFrame(rows, SCHEMA))
    assert Counter(tuple(r) for r in got.collect()) == manifest(rows)
    none = merkle.merkle_manifest(spark.createDataFrame([], SCHEMA))
    assert none.columns == got.columns and none.count() == 0


def same(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize(("n", "fan", "parts"), [(1, 8, 1), (300, 2, 11), (300, 8, 20), (40, 3, 1)])
def test_exact_dedup(spark, n, fan, parts):
    docs, rows = documents(spark, n, n + fan)
    got = exact_dedup.exact_dedup(docs.repartition(parts), fan).collect()
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[same(t)].append(d)
    stays = {t: min((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    want = Counter((d, stays[same(t)], len(groups[same(t)]), h(same(t))) for d, t, *_ in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert sorted(r["text_sha256"] for r in kept) == sorted(map(h, groups)) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_equal_digests_alone_do_not_merge(spark):
    entries = spark.createDataFrame([(0, b"d", 1, 5, (False, 3, 1), 1), (1, b"d", 1, 5, (False, 2, 9), 4), (1, b"d", 2, 5, (False, 1, 8), 1)], "run long, digest binary, length int, second long, least struct<last: boolean, doc_id: long, row: long>, n long")
    got = exact_dedup.merged(entries, F.lit(0)).orderBy("length").collect()
    assert [(r["least"]["doc_id"], r["n"]) for r in got] == [(2, 5), (1, 1)]


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def clustered(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    if not kept:
        return Counter()
    v = np.array([x for _, x in kept])
    first = sorted(kept, key=lambda r: (h("1:" + ("null" if r[0] is None else str(r[0]))), r[1]))[:k]
    c = np.array([x for _, x in first])
    for step in range(rounds + 1):
        d = ((v[:, None] - c[None]) ** 2).sum(2)
        to = d.argmin(1)
        if step < rounds:
            c = np.array([v[to == j].sum(0) // (to == j).sum() if (to == j).any() else c[j] for j in range(len(c))])
    own = d.min(1)
    return Counter((i, int(t), int(o), int(own[to == t].sum()), int(own.sum()), h(",".join(map(str, c[t])))) for (i, _), t, o in zip(kept, to, own, strict=True))


VECTORS = "vec_id long, embedding array<float>, cluster string, v int"


@pytest.mark.parametrize("kind", ["spread", "tight", "ties", "few", "none"])
def test_clusters(spark, kind):
    r = np.random.default_rng(5)
    n = {"few": 5, "none": 0}.get(kind, 1500)
    middle = r.normal(size=(20, 64)) * (2 if kind == "tight" else 0.1)
    x = middle[r.integers(0, 20, n)] + r.normal(size=(n, 64)) * 0.125
    x = np.round(x * 2) / 64 if kind == "ties" else x  # few values: many vectors are equal or as far from two centroids
    rows = [(k if k % 50 else None, e.astype(np.float32).tolist()) for k, e in enumerate(x)]
    odd = [(9001, None), (9002, [0.0] * 63), (9003, [0.0] * 63 + [None]), (9004, [0.0] * 63 + [float("nan")]), (9005, [float("inf")] + [0.0] * 63), (9006, [])]
    rows = (rows + rows[:30]) + odd
    got = clustering.cluster(spark.createDataFrame([(*x, "clash", 1) for x in rows], VECTORS).repartition(5))
    assert Counter(tuple(y) for y in got.collect()) == clustered(rows)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_spare_scans():
    """Vectors of groups far apart are not scanned again, and the others come out as by a scan."""
    r = np.random.default_rng(1)
    c = r.integers(-300, 300, (16, 64))
    v = c[r.integers(0, 16, 4000)] + r.integers(-8, 9, (4000, 64))
    cluster, _, upper, lower = clustering.Moves(c, None).scan(v)
    new = c + r.integers(-2, 3, c.shape)
    moves, scanned = clustering.Moves(new, c), []
    scan = moves.scan
    moves.scan = lambda x: scanned.append(len(x)) or scan(x)
    got = moves.go_on(v, cluster, upper, lower, False)
    assert (got[0] == scan(v)[0]).all() and sum(scanned) < 400 and (got[1] == -1).sum() > 3000
    assert (got[2] ** 2 >= clustering.squares(v, new).min(1)).all()


def test_too_large_components(spark):
    rows = [(1, [4e6] + [0.0] * 63, "", 1)]
    with pytest.raises(Exception, match="beyond 2"):
        clustering.cluster(spark.createDataFrame(rows, VECTORS)).collect()
