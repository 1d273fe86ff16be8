"""Merkle manifest of a table of documents, with a proof for each row by coordinate lookup.

A leaf is the digest of a row's columns. A source's leaves ascend by doc_id and are folded
three at a time up to its subroot, and the subroots, by source, in the same way up to the root.

A node's coordinates are its tree, level and place, and the siblings that a proof needs follow
from the place and the number of leaves alone. So leaves explode the coordinates of their
siblings, join the table of nodes, and concatenate and fold what they get, in order.

How this stays bounded: places come from one range sort of digests (never of texts) and the
counts of its partitions, so that no task sees a whole source. Nodes are made ``SPAN`` levels at
a time from blocks of 3^``SPAN`` neighbouring nodes, whose siblings all lie in the same block.
Leaves look up the levels of their own block; a block looks up those above for all its leaves
at once, and so on up, so that no node is asked for by more than a block's leaves, however high
it stands. Each level's nodes are a written table.

Cases: null columns are ``-``; an empty text is ``0:``; within a source null ids come first and
rows of one id are in the order of their leaves; equal rows are leaves of their own, next to
each other; a row without an id is never tampered with; a lone source's subroot is the root,
and a lone leaf both, with an empty proof; an empty table gives an empty one; further columns
are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.shared import discard, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SPAN = 5
BLOCK = 3**SPAN
POWERS = "array(" + ", ".join(f"{3**k}L" for k in range(40)) + ")"
POWER = f"element_at({POWERS}, CAST({{}} AS INT) + 1)"
#: Levels above the leaves, over n, the number of a tree's leaves.
HEIGHT = f"size(filter({POWERS}, p -> p < n))"
HEX = "lower(hex({}))"
#: Of an array of nodes as hex text, that of their parents.
STEP = "transform(sequence(0, CAST((size({0}) + 2) div 3 AS INT) - 1), i -> sha2(array_join(slice({0}, i * 3 + 1, 3), ''), 256))"
LEVELS = f"aggregate(sequence(1, {SPAN}), array(transform(run, e -> {HEX.format('e.digest')})), (a, k) -> concat(a, array({STEP.format('a[k - 1]')})))"
PATH = "array<struct<left: string, right: string>>"


def leaf(text: Column) -> Column:
    """Digest of a row, with ``text`` in its column's place."""
    values = [text if c == "text" else F.col(c).cast("string") for c in FIELDS]
    return F.sha2(F.concat(*(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values)), 256)


def tampered() -> Column:
    """Whether the row is one that tampering changes."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))


def ranked(rows: DataFrame, tree: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows, sorted by tree and order and written, with their partition and place in it; and for
    each tree and partition (tree, part) n, the tree's rows, and shift, which added to the place
    in the partition gives the place in the tree. Equal rows are split anywhere."""
    by = [tree, *order, "_any"]
    placed = rows.withColumn("_any", F.rand(11)).repartitionByRange(*by).sortWithinPartitions(*by).drop("_any").withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumns({"part": F.shiftright("_at", 33), "at": F.col("_at").bitwiseAND(F.lit(2**33 - 1))}).drop("_at")
    placed = written(placed, "sorted")
    counts = placed.groupBy(tree, "part").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    all_ = Window.partitionBy(tree)  # a row for each partition that the tree reaches into
    before = F.sum("here").over(all_.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return placed, counts.select(tree, "part", F.sum("here").over(all_).alias("n"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))


def nodes(leaves: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """leaves: tree, n, idx, digest (binary). For each ``SPAN`` levels the nodes they start from and
    those made of them, up to the level at which the next ones start: tree, n, level, idx, digest."""
    tallest = leaves.agg(F.max(F.expr(HEIGHT))).first()[0] or 0
    base, level, out = leaves.select("tree", "n", F.lit(0).alias("level"), "idx", "digest"), 0, []
    while level < tallest or not out:
        blocks = base.groupBy("tree", "n", F.expr(f"idx div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))
        made = blocks.select("tree", "n", "block", F.explode(F.array(F.struct(F.expr(LEVELS).alias("levels")))).alias("m"))
        made = made.select("tree", "n", "block", F.posexplode("m.levels").alias("k", "nodes")).where(f"k > 0 AND {level} + k <= {HEIGHT}")
        made = made.select("tree", "n", "block", "k", F.posexplode("nodes").alias("j", "hex"))
        idx = F.expr(f"block * {POWER.format(f'{SPAN} - k')} + j")
        made = written(made.select("tree", "n", (F.col("k") + level).alias("level"), idx.alias("idx"), F.unhex("hex").alias("digest")), "nodes")
        out.append((base, made))
        level += SPAN
        base = made.where(f"level = {level} AND {HEIGHT} > {level}")
    return out


def subroots(rounds: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """tree, n, digest: the last node of each tree."""
    out = rounds[0][0].where("n = 1")
    for _, made in rounds:
        out = out.unionByName(made.where(f"level = {HEIGHT}"))
    return out.select("tree", "n", "digest")


def looked_up(base: DataFrame, table: DataFrame, level: int, own: list[str]) -> DataFrame:
    """tree, block, idx, the columns ``own`` and path: for each of the ``SPAN`` levels from here on
    the siblings before and after, as hex text. base: tree, n, idx and own; table: the nodes."""
    j, here = f"least({SPAN}, {HEIGHT} - {level})", lambda k: f"idx div {POWER.format(k)}"
    sibling = f"e -> e.sib <> {here('e.level - ' + str(level))} AND e.sib < (n + {POWER.format('e.level')} - 1) div {POWER.format('e.level')}"
    coordinates = f"flatten(transform(sequence(0, {j} - 1), j -> filter(transform(array(0L, 1L, 2L), s -> named_struct('level', {level} + j, 'sib', {here('j + 1')} * 3 + s)), {sibling})))"
    asked = base.where(f"{HEIGHT} > {level}").select("tree", "idx", F.explode(F.array(F.struct(F.expr(coordinates).alias("all")))).alias("c"))
    asked = asked.select("tree", "idx", F.explode("c.all").alias("c")).select("tree", "idx", "c.level", "c.sib")
    found = asked.join(table.select("tree", "level", F.col("idx").alias("sib"), "digest"), ["tree", "level", "sib"])
    found = found.select("tree", "idx", F.struct("level", "sib", "digest").alias("node"))
    rows = found.unionByName(base.select("tree", "idx", F.struct("n", *own).alias("own")), allowMissingColumns=True).withColumn("block", F.expr(f"idx div {BLOCK}"))
    # one exchange by block serves the grouping and the join with what stands above the block
    rows = rows.repartition("tree", "block").groupBy("tree", "block", "idx").agg(F.first("own", ignorenulls=True).alias("own"), F.sort_array(F.collect_list("node")).alias("nodes"))
    rows = rows.select("tree", "block", "idx", "own.*", "nodes")
    side = lambda sign: f"array_join(transform(filter(nodes, e -> e.level = {level} + j AND e.sib {sign} {here('j')}), e -> {HEX.format('e.digest')}), '')"
    path = f"CASE WHEN {HEIGHT} > {level} THEN transform(sequence(0, {j} - 1), j -> named_struct('left', {side('<')}, 'right', {side('>')})) ELSE CAST(array() AS {PATH}) END"
    return rows.select("tree", "block", "idx", *own, F.expr(path).alias("path"))


def paths(leaves: DataFrame, own: list[str], rounds: list[tuple[DataFrame, DataFrame]], ends: DataFrame) -> DataFrame:
    """leaves with their whole path and the columns of ``ends``. ends: tree, n, path (from the tree's
    last node on) and others."""
    above, rest = None, [c for c in ends.columns if c not in ("tree", "n", "path")]
    for r in reversed(range(len(rounds))):
        level, (base, made) = r * SPAN, rounds[r]
        table = base.unionByName(made.where(f"level < {level + SPAN}"))
        last = ends.where(f"{HEIGHT} <= {level + SPAN}").select("tree", F.lit(0).cast("long").alias("block"), F.col("path").alias("on"), *rest)
        above = last if above is None else above.unionByName(last)
        part = looked_up(base if r else leaves, table, level, [] if r else own)
        whole = part.join(above, ["tree", "block"]).withColumn("path", F.concat("path", "on")).drop("on")
        if r:
            above = written(whole.select("tree", F.col("idx").alias("block"), F.col("path").alias("on"), *rest), "paths")
    return whole


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row."""
    bare = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    changed = F.when(tampered() & F.contains("text", F.lit("\n")), F.unhex(leaf(bare)))
    # a text that sorts null first and then as the source does
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(*(F.col(c).cast("string").alias(c) if c in ("source", "lang", "text") else F.col(c).cast("long").alias(c) for c in FIELDS))
    rows = written(rows.select(key.alias("key"), "doc_id", F.unhex(leaf(F.col("text"))).alias("digest"), changed.alias("changed")), "digests")
    placed, shifts = ranked(rows, "key", ["doc_id", "digest"])
    shifts = written(shifts, "shifts")

    sources, above = ranked(shifts.groupBy("key").agg(F.first("n").alias("leaves")).withColumn("top", F.lit(0)), "top", ["key"])
    sources = sources.join(above, ["top", "part"]).select("key", F.col("leaves"), F.lit(-1).cast("long").alias("top"), "n", (F.col("at") + F.col("shift")).alias("idx"))
    sources = written(sources, "sources")
    shifts = shifts.join(sources.select("key", F.col("idx").alias("tree")), "key").select("key", "part", "tree", "n", "shift")
    leaves = placed.join(shifts, ["key", "part"]).select("tree", "n", (F.col("at") + F.col("shift")).alias("idx"), "doc_id", "digest", "changed")
    leaves = written(leaves, "leaves")
    discard(rows, placed)

    rounds = nodes(leaves)
    tops = written(subroots(rounds).select("tree", F.col("n").alias("leaves"), "digest").join(sources.select(F.col("idx").alias("tree"), "n"), "tree"), "subroots")
    top_leaves = tops.select(F.lit(-1).cast("long").alias("tree"), "n", F.col("tree").alias("idx"), "digest", "leaves")
    top_rounds = nodes(top_leaves)
    root = subroots(top_rounds).select("tree", "n", F.expr(f"CAST(array() AS {PATH})").alias("path"), F.col("digest").alias("root"))
    ends = paths(top_leaves, ["leaves", "digest"], top_rounds, root)
    ends = written(ends.select(F.col("idx").alias("tree"), F.col("leaves").alias("n"), "path", F.col("digest").alias("subroot"), "root"), "ends")

    whole = paths(leaves, ["doc_id", "digest", "changed"], rounds, ends)
    fold = f"aggregate(path, {HEX.format('coalesce(changed, digest)')}, (d, e) -> sha2(concat(e.left, d, e.right), 256))"
    made = F.struct(F.expr("sha2(array_join(transform(path, e -> concat(e.left, e.right)), ''), 256)").alias("proof_sha256"), F.expr(fold).alias("folded_root"))
    out = whole.select("doc_id", *(F.lower(F.hex(c)).alias(n) for c, n in (("digest", "leaf"), ("subroot", "subroot"), ("root", "root"))), F.explode(F.array(made)).alias("m"))
    return out.select("doc_id", "leaf", "subroot", "root", "m.*", (F.col("m.folded_root") == F.col("root")).alias("verified"))


def _sql() -> str:
    """In SQL: levels by recursion, each leaf's steps by a join, the fold by recursion again."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf_of = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    tree = lambda name, leaves: f"""
{name} AS (
  SELECT t, n, 0 AS level, i, digest FROM {leaves}
  UNION ALL
  SELECT t, (n + 2) // 3, level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY t, n, level, i // 3
)"""  # noqa: E731
    steps = lambda nodes: f"""SELECT l.row, l.t, o.level, coalesce(string_agg(s.digest, '' ORDER BY s.i) FILTER (WHERE s.i < o.i), '') AS a, coalesce(string_agg(s.digest, '' ORDER BY s.i) FILTER (WHERE s.i > o.i), '') AS b
  FROM own l JOIN {nodes} o ON o.t = l.t AND o.n > 1 AND o.i = l.i // CAST(pow(3, o.level) AS BIGINT) LEFT JOIN {nodes} s ON s.t = o.t AND s.level = o.level AND s.i // 3 = o.i // 3 AND s.i <> o.i GROUP BY l.row, l.t, o.level, o.i"""  # noqa: E731
    return f"""
WITH RECURSIVE bits AS (
  SELECT b, 0 AS k, b AS c FROM (SELECT CAST(b AS BIGINT) AS b FROM range(256) r(b)) UNION ALL SELECT b, k + 1, {bit} FROM bits WHERE k < 8
), crcs AS (SELECT b, c FROM bits WHERE k = 8),
sums AS (
  SELECT doc_id, 0 AS k, 4294967295 AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL SELECT s.doc_id, s.k + 1, xor(s.c >> 8, r.c) FROM sums s JOIN crcs r ON r.b = xor(s.c & 255, ascii(substr(CAST(s.doc_id AS VARCHAR), s.k + 1, 1))) WHERE s.k < len(CAST(s.doc_id AS VARCHAR))
), odd AS (SELECT doc_id, c & 1 AS c FROM sums WHERE k = len(CAST(doc_id AS VARCHAR))),
d AS (
  SELECT doc_id, source, {leaf_of('text')} AS leaf, CASE WHEN odd.c = 1 THEN {leaf_of("replace(text, chr(10), '')")} END AS changed FROM documents LEFT JOIN odd USING (doc_id)
), l AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS row, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d
), x AS (SELECT t, n, i, leaf AS digest FROM l),
{tree('low', 'x')},
subs AS MATERIALIZED (SELECT t, digest FROM low WHERE n = 1),
y AS (SELECT -1 AS t, (SELECT count(*) FROM subs) AS n, t AS i, digest FROM subs),
{tree('high', 'y')},
own AS (SELECT row, t, i FROM l UNION ALL SELECT -1 - t, -1, t FROM subs),
low_m AS MATERIALIZED (SELECT * FROM low), high_m AS MATERIALIZED (SELECT * FROM high),
low_steps AS ({steps('low_m')}),
high_steps AS ({steps('high_m')}),
heights AS (SELECT t, max(level) AS h FROM low_m GROUP BY t),
steps AS MATERIALIZED (
  SELECT row, level, a, b FROM low_steps
  UNION ALL SELECT l.row, heights.h + s.level, s.a, s.b FROM l JOIN heights USING (t) JOIN high_steps s ON s.row = -1 - l.t
), fold AS (
  SELECT row, 0 AS level, coalesce(changed, leaf) AS digest FROM l
  UNION ALL SELECT f.row, f.level + 1, sha256(s.a || f.digest || s.b) FROM fold f JOIN steps s ON s.row = f.row AND s.level = f.level
), proofs AS (SELECT row, string_agg(a || b, '' ORDER BY level) AS p FROM steps GROUP BY row),
roots AS (SELECT digest AS root FROM high_m WHERE n = 1), folded AS (SELECT row, max_by(digest, level) AS folded_root FROM fold GROUP BY row)
SELECT doc_id, leaf, subs.digest AS subroot, root, sha256(coalesce(p, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN subs USING (t) JOIN folded USING (row) LEFT JOIN proofs USING (row), roots
"""


ORACLE_SQL = _sql()
