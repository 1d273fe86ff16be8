"""Near-duplicate embeddings by lattice hashing.

Vectors of one label that are equal become one class. Classes are hashed: in each of several
tables, random orthogonal projections take a unit vector into ``BLOCKS`` times 8 dimensions,
and each 8 are decoded to the nearest point of the lattice E8; the label and the points
make the vector's cell. Besides its own cell a vector is entered into the neighbouring
cell that it is nearest to, so that pairs meet across a cell's wall. Those that meet are
compared by cosine, in double precision.

No pair is ever written out. What meets in a cell is compared in blocks; a block gives for
each of its vectors the number of links found, and a spanning forest of the links. A pair
that meets in several cells counts in the one with the least key of those that both hold.
A cell with more than ``SIDE`` vectors is dealt into parts, and each pair of parts is a
block of its own, so that no task holds a whole large cell, whatever its size.

Recall on 10,256 vectors against brute force: see the README; it is at least 0.9.

Cases: null, zero or not finite vectors, those with null components, and those with a null
label link with nothing; a null id has links but never names a component (a component of
null ids alone has id null); rows of one id are one vector as to components; vectors of
different lengths are not compared; an empty table gives an empty one; other columns drop.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.components import components
from kinfold.llm.shared import written

COSINE = 0.98
TABLES = 4
BLOCKS = 2
SCALE = 0.8  # a lattice step, for projections that keep lengths on average
SIDE = 512
SEED = 11


def decode_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with integer coordinates of even sum."""
    r = np.rint(x)
    off = x - r
    odd = (r.sum(1).astype(np.int64) & 1) == 1
    worst = np.abs(off).argmax(1)
    rows = np.flatnonzero(odd)
    r[rows, worst[rows]] += np.where(off[rows, worst[rows]] >= 0, 1.0, -1.0)
    return r


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: of D8, or of D8 moved by a half in each coordinate."""
    a, b = decode_d8(x), decode_d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(near[:, None], a, b)


@functools.lru_cache(maxsize=1)
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of 1 or -1, or all of a half with an
    even number of minus signs."""
    pairs = [(i, j, a, b) for i in range(8) for j in range(i) for a in (1, -1) for b in (1, -1)]
    out = np.zeros((240, 8))
    for k, (i, j, a, b) in enumerate(pairs):
        out[k, i], out[k, j] = a, b
    signs = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(float)
    out[len(pairs) :] = 0.5 - signs[signs.sum(1) % 2 == 0]
    return out


@functools.lru_cache(maxsize=256)
def projection(size: int, table: int, block: int) -> np.ndarray:
    rng = np.random.default_rng([SEED, size, table, block])
    m = rng.normal(size=(size, 8))
    return np.linalg.qr(m)[0] * np.sqrt(size / 8) if size >= 8 else m / np.sqrt(8)


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of rows of integers."""
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            h = (h ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xC4CEB9FE1A85EC53)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells(unit: np.ndarray, label: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE) -> np.ndarray:
    """Keys of the cells of each vector: own and neighbouring, table by table."""
    n, size, out = len(unit), unit.shape[1], []
    for t in range(tables):
        own, step, gain = [], [], []
        for b in range(blocks):
            y = unit @ projection(size, t, b) / scale
            e = decode_e8(y)
            g = (y - e) @ neighbours().T
            best = g.argmax(1)
            own.append(np.rint(2 * e))
            step.append(np.rint(2 * neighbours()[best]))
            gain.append(g[np.arange(n), best])
        move = np.argmax(gain, 0)
        other = [o + s * (move == b)[:, None] for b, (o, s) in enumerate(zip(own, step, strict=True))]
        for which in (own, other):
            out.append(mixed([label, np.full(n, size), np.full(n, t), *np.concatenate(which, 1).T]))
    return np.stack(out, 1)


def forest(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a square 0/1 matrix, as (vertex, the one it was reached from)."""
    left, out = np.ones(len(adjacent), bool), []
    while left.any():
        stack = [int(left.argmax())]
        left[stack[0]] = False
        while stack:
            at = stack.pop()
            for k in np.flatnonzero(adjacent[at] & left):
                left[k] = False
                out.append((int(k), at))
                stack.append(int(k))
    return out


def compare(own: pd.DataFrame, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Of the rows of one block: which row has links, how many, and the forest (class ids)."""
    x = np.stack([np.frombuffer(v, np.float64) for v in own.vec])
    keys = np.stack([np.frombuffer(v, np.int64) for v in own["keys"]])
    meet = np.triu(x @ x.T >= cosine, 1)
    part = own.part.to_numpy()
    if own.i.iloc[0] != own.j.iloc[0]:
        meet &= part[:, None] != part[None, :]
    a, b = np.nonzero(meet)
    if len(a):  # each pair once: in the least cell that both are entered in
        least = np.full(len(a), np.iinfo(np.int64).max)
        for c in range(keys.shape[1]):
            for d in range(keys.shape[1]):
                same = keys[a, c] == keys[b, d]
                least = np.where(same, np.minimum(least, keys[a, c]), least)
        mine = least == own.key.iloc[0]
        meet[a[~mine], b[~mine]] = False
        a, b = a[mine], b[mine]
    m, ids = own.m.to_numpy(), own.cid.to_numpy()
    links = np.bincount(a, m[b], len(own)) + np.bincount(b, m[a], len(own))
    return ids, links.astype(np.int64), [(int(ids[k]), int(ids[p])) for k, p in forest(meet | meet.T)] if len(a) else []


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, side: int = SIDE) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding, label)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("fine", F.coalesce(F.col("label").isNotNull() & fine, F.lit(False)))
    v = v.withColumn("cid", F.when(F.col("fine"), F.xxhash64("label", "embedding")))
    classes = v.where("fine").groupBy("cid").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("m"), F.min("vec_id").alias("least"))

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, b in batch.groupby(batch.embedding.map(len)):
                x = np.stack(b.embedding.to_numpy()).astype(np.float64)
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                k = cells(x, b.label.to_numpy())
                raw, all_ = [r.tobytes() for r in x], [r.tobytes() for r in k]
                n = k.shape[1]
                yield pd.DataFrame({"key": k.ravel(), "cid": np.repeat(b.cid.to_numpy(), n), "m": np.repeat(b.m.to_numpy(), n), "vec": np.repeat(np.array(raw, object), n), "keys": np.repeat(np.array(all_, object), n)}).drop_duplicates(["key", "cid"])

    entered = written(classes.select("cid", "label", "embedding", "m").mapInPandas(enter, "key long, cid long, m long, vec binary, keys binary"), "cells")
    shared = entered.groupBy("key").count().where("count > 1")
    parts = F.ceil(F.col("count") / side).cast("int")
    dealt = entered.join(shared, "key").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("part", "k").alias("i"), F.greatest("part", "k").alias("j"), "part", "cid", "m", "vec", "keys")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            key = np.stack([b.key, b.i, b.j], 1)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
            rest = b.iloc[starts[-1] :]
            yield from blocks(b, starts)
        if rest is not None and len(rest):
            yield from blocks(rest, np.array([0, len(rest)]))

    def blocks(b: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        """The blocks between the starts; those of two rows all at once."""
        sizes, out = np.diff(starts), []
        two = starts[:-1][sizes == 2]
        for s, e in zip(starts[:-1][sizes > 2], starts[1:][sizes > 2], strict=True):
            ids, links, tree = compare(b.iloc[s:e], cosine)
            out += [(i, n, None) for i, n in zip(ids[links > 0].tolist(), links[links > 0].tolist(), strict=True)]
            out += [(c, 0, p) for c, p in tree]
        if len(two):
            p, q = b.iloc[two], b.iloc[two + 1]
            x, y = (np.stack([np.frombuffer(v, np.float64) for v in r.vec]) for r in (p, q))
            same = ((x * y).sum(1) >= cosine) & ((p.i.to_numpy() == p.j.to_numpy()) | (p.part.to_numpy() != q.part.to_numpy()))
            for r in np.flatnonzero(same):
                ids, links, tree = compare(b.iloc[two[r] : two[r] + 2], cosine)
                out += [(int(i), int(n), None) for i, n in zip(ids, links, strict=True) if n]
                out += [(c, 0, o) for c, o in tree]
        if out:
            yield pd.DataFrame(out, columns=["cid", "links", "other"]).astype({"other": "Int64"})

    spark = vectors.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = dealt.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(meet, "cid long, links long, other long")
    found = written(found, "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.where("other IS NOT NULL").select(F.col("cid").alias("u"), F.col("other").alias("v")))
    by_class = classes.select("cid", "m", "least").join(links, "cid", "left").join(roots.withColumnRenamed("id", "cid"), "cid", "left")
    by_class = by_class.select("cid", "m", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root"))
    named = by_class.join(by_class.groupBy("root").agg(F.min("least").alias("component")), "root").select("cid", (F.col("m") - 1 + F.col("links")).alias("links"), "component")
    out = v.select("vec_id", "cid").join(named, "cid", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
