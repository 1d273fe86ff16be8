"""N-gram Jaccard join: documents whose sets of word shingles are alike, by grouped prefixes.

A document's set: the 64-bit hashes of its distinct five-word shingles. All sets are put in
one order, frequent shingles last; two sets of a Jaccard similarity of 0.75 or more then have
a shingle in common among the first n - ceil(0.75 n) + 1 of each (the prefix).

1. Documents with the same prefix and size are one group; the index over prefix shingles holds
   groups. An entry goes that no other group of a size within the threshold has.
2. Group pairs are filtered by size, by the place of the shingle, and by how many entries each of
   the two has from there on; groups expand to their distinct sets (equal sets are one class, named by
   its smallest doc_id).
3. Members are verified on their whole sets. As links are wanted for components, pairs already
   connected need no proof: first each shingle's members are verified against its first pivot,
   then those of shingles with many members against seven more; then all pairs left of one
   shingle that are in different components and were not verified yet. In that last step each
   such pair has a member outside the shingle's largest component, so that a large group of
   copies, which is one component by then, costs no more than its size. No link is lost.

Frequencies only decide the order, and any order is exact. They are counted over all documents;
shingles that occur seldom within each part of a task's documents count as rare. In the index,
entries of a frequent shingle are dealt into parts.

Cases: without words or text the set is empty, and links with nothing; with fewer words than
five the whole sequence is the one shingle; rows of one doc_id are one document as to links;
null ids link with nothing and have a null component; an empty table gives an empty one;
other columns drop. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.components import components
from kinfold.llm.shared import discard, small_batches, written

WORDS = 5
PERCENT = 75
#: A shingle counts as frequent from IN_PART occurrences among TOGETHER of a task's shingles on;
#: of the frequent ones the first FREQUENT are put last in the order (a bound of what is broadcast:
#: 16 MB). Rows of one of these are dealt into SALTS parts.
IN_PART = 3
TOGETHER = 4_000_000
FREQUENT = 1_000_000
SALTS = 64
PIVOTS = 8
KEPT = 1_000_000
LONG = 48
SKETCH = 1024
BITS = 1 << 24


@functools.lru_cache(maxsize=1)
def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each byte a random number, A-Z as a-z, and whether it is white space."""
    numbers = np.random.default_rng(20).integers(0, 2**64, 256, np.uint64)
    numbers[65:91] = numbers[97:123]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return numbers, space


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and of which text each word is. Words are read a byte
    at a time, all at once; the few that are longer than LONG are hashed one by one."""
    numbers, space = byte_tables()
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gap = space[buf]
    edge = np.flatnonzero(np.diff(np.r_[True, gap].view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    h = np.full(len(starts), 0x9E3779B97F4A7C15, np.uint64)
    size = ends - starts
    at, place = starts.copy(), np.flatnonzero(size > 0)
    with np.errstate(over="ignore"):
        for k in range(LONG):
            place = place[size[place] > k]
            if not len(place):
                break
            h[place] = (h[place] ^ numbers[buf[at[place] + k]]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
        for w in place[size[place] > LONG]:
            h[w] ^= np.uint64(xxhash.xxh3_64_intdigest(buf[starts[w] : ends[w]].tobytes().lower()))
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    after = np.cumsum([len(t) + 1 for t in texts])
    return h, np.searchsorted(after, starts, "right")


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in order, repeats included, and of which text each is."""
    h, of = word_hashes([t.encode() for t in texts])
    count = np.bincount(of, minlength=len(texts))
    if not len(h):
        return np.zeros(0, np.int64), of
    length = np.minimum(count, WORDS)[of]  # of the shingle that begins at a word
    first = np.r_[0, np.cumsum(count)][of]
    begins = np.flatnonzero(np.arange(len(h)) - first + length <= count[of])
    begins = begins[(count[of[begins]] >= WORDS) | (begins == first[begins])]
    out, length = length[begins].astype(np.uint64), length[begins]
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            more = h[np.minimum(begins + k, len(h) - 1)]
            new = (out ^ more) * np.uint64(0xA0761D6478BD642F)
            new ^= new >> np.uint64(29)
            out = np.where(length > k, new, out)
    return out.view(np.int64), of[begins]


def sets(texts: list[str]) -> list[np.ndarray]:
    """For each text the distinct hashes of its shingles, ascending."""
    h, of = shingle_hashes(texts)
    ends = np.cumsum(np.bincount(of, minlength=len(texts)))
    out = []
    for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
        x = np.sort(h[a:b])
        out.append(x[np.r_[True, x[1:] != x[:-1]]] if len(x) > 1 else x)
    return out


def digest(x: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell a set of hashes from others."""
    u = x.view(np.uint64)
    with np.errstate(over="ignore"):
        v = (u ^ (u >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        a, b = u.sum(dtype=np.uint64), (v ^ (v >> np.uint64(32))).sum(dtype=np.uint64)
    return int(np.uint64(a).view(np.int64)), int(np.uint64(b).view(np.int64))


def parities(x: np.ndarray) -> np.ndarray:
    """For each of SKETCH classes of hashes, a bit: whether an odd number of the set's is in it."""
    odd = np.bincount((x.view(np.uint64) >> np.uint64(20)).astype(np.int64) & (SKETCH - 1), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def rest_size(n: str, percent: int = PERCENT) -> str:
    """What a set has beyond its prefix, in SQL."""
    return f"(({percent} * {n} + 99) div 100 - 1)"


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, ascending, and how often each occurs (FREQUENT at most)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for b in batches:
            parts.append(shingle_hashes(b.text.tolist())[0])
            size += len(parts[-1])
            if size >= TOGETHER:
                yield runs(np.concatenate(parts))
                parts, size = [], 0
        if size:
            yield runs(np.concatenate(parts))

    def runs(x: np.ndarray) -> pd.DataFrame:
        """What occurs IN_PART times or more."""
        x.sort()
        starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        n = np.diff(np.r_[starts, len(x)])
        return pd.DataFrame({"h": x[starts[n >= IN_PART]], "n": n[n >= IN_PART]})

    counts = written(docs.mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "frequent")
    # how many there are of each size of count, so that no task or driver sees more than FREQUENT
    size = F.floor(F.log2("n") * 64).cast("int")
    least, total = 1 << 30, 0
    for r in sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect(), reverse=True):
        total += r["n"]
        if total > FREQUENT:
            break
        least = r["size"]
    rows = counts.where(size >= least).toArrow()  # no Python objects: 16 bytes a row
    discard(counts)
    h, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("h", "n"))
    order = np.argsort(h)
    return h[order], n[order]


def prefix_of(x: np.ndarray, often: np.ndarray, count: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, int]:
    """The first of a set in the common order: rare shingles by hash, then frequent ones by
    frequency and hash; and how many of them are rare. ``seen`` tells for the low bits of a hash
    whether it may be frequent."""
    size = prefix_size(len(x))
    may = np.flatnonzero(seen[x & (len(seen) - 1)])
    if len(may):
        at = np.minimum(np.searchsorted(often, x[may]), len(often) - 1)
        hit = often[at] == x[may]
        may, at = may[hit], at[hit]
        if len(may):
            rare = np.delete(x, may)
            return (rare[:size], size) if len(rare) >= size else (np.r_[rare, x[may[np.argsort(count[at], kind="stable")]]][:size], len(rare))
    return x[:size], size


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), a, b (its digests), g (of its prefix and size), bits (see
    parities), rare (how many of the prefix are not frequent) and prefix; that is null where an
    earlier row of the same task has the same, so that of a large group of copies no more
    prefixes go into the index than there are tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (often, count), known = shared.value, set()
        low = np.zeros(1 << 20, bool)
        low[often & (len(low) - 1)] = True
        for b in batches:
            if len(known) > KEPT:
                known.clear()
            out = []
            for d, x in zip(b.doc_id, sets(b.text.tolist()), strict=True):
                p, rare = prefix_of(x, often, count, low)
                g, has = digest(p)[1] ^ (len(x) << 40), not pd.isna(d)
                out.append((int(d) if has else None, len(x), *digest(x), g, parities(x), rare, None if g in known or not has else p))
                if has:
                    known.add(g)
            yield pd.DataFrame(out, columns=["doc_id", "n", "a", "b", "g", "bits", "rare", "prefix"]).astype({"doc_id": "Int64"})

    return written(docs.mapInPandas(run, "doc_id long, n long, a long, b long, g long, bits array<long>, rare long, prefix array<long>"), "signatures")


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is in ids (each there once). Before texts are shuffled for the join, a bitmap of
    the ids' hashes, of at most BITS / 64 rows whatever their number, drops most others."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    bits = ids.select((bit / 64).cast("int").alias("_word"), F.expr("shiftleft(1L, cast(%s %% 64 AS int))" % f"pmod(xxhash64(doc_id), {BITS}L)").alias("_bit"))
    bits = bits.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    near = docs.join(F.broadcast(bits), F.floor(bit / 64).cast("int") == F.col("_word")).where(f"getbit(_bits, cast(pmod(xxhash64(doc_id), {BITS}L) % 64 AS int)) = 1")
    return near.select(*docs.columns).join(ids, "doc_id")  # a semi-join would be moved before the bitmap


def members(pairs: DataFrame) -> DataFrame:
    """The ids in pairs u, v, each once, as doc_id."""
    return pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct()


def verify(pairs: DataFrame, lists: DataFrame, sketches: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of the candidate pairs u, v: u, v, linked.

    First by the prefixes: two sets that link have so many shingles in common that, as what lies
    beyond a prefix is of known size, enough of them must be in both prefixes (lists holds what
    a prefix shares with another group's; low bits of these are compared, as many as fell together
    counted on top; of one group, all is shared). Then by the sketches (doc_id, n, bits): no more bits differ than
    there are shingles that only one of both has. What passes is verified on the whole sets, made again from the
    texts of just those documents."""
    low = F.array_distinct(F.transform("entries", lambda e: e["h"].bitwiseAND(0x7FFFFFFF).cast("int")))
    a = lists.select(F.col("cid").alias("u"), "n", F.col("g").alias("e"), low.alias("x"), (F.size("entries") - F.size(low)).alias("lost"))
    b = lists.select(F.col("cid").alias("v"), F.col("n").alias("o"), F.col("g").alias("f"), low.alias("y"))
    enough = f"e = f OR size(array_intersect(x, y)) + lost >= {in_prefixes(percent)}"
    tried = written(pairs.join(a, "u").join(b, "v").where(enough).select("u", "v").distinct(), "tried")
    bits = only(sketches, members(tried))
    a = bits.select(F.col("doc_id").alias("u"), "n", F.col("bits").alias("x"))
    b = bits.select(F.col("doc_id").alias("v"), F.col("n").alias("o"), F.col("bits").alias("y"))
    near = f"(100 + {percent}) * (n + o - aggregate(zip_with(x, y, (p, q) -> bit_count(p ^ q)), 0, (p, q) -> p + q)) >= 2 * {percent} * (n + o)"
    pairs = written(tried.join(a, "u").join(b, "v").where(near).select("u", "v"), "pairs")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"id": x.doc_id, "s": sets(x.text.tolist())})

    whole = written(only(docs, members(pairs)).mapInPandas(run, "id long, s array<long>"), "sets")
    a, b = whole.select(F.col("id").alias("u"), F.col("s").alias("x")), whole.select(F.col("id").alias("v"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    linked = 100 * both >= percent * (F.size("x") + F.size("y") - both)
    out = written(pairs.join(b, "v").join(a, "u").groupBy("u", "v").agg(F.max(linked).alias("linked")), "verified")
    discard(tried, pairs, whole)
    return out


def in_prefixes(percent: int = PERCENT) -> str:
    """How many shingles sets of sizes n and o that link have in common within their prefixes."""
    return f"ceil({percent} * (n + o) / {100.0 + percent}) - greatest({rest_size('n', percent)}, {rest_size('o', percent)})"


def alike(percent: int = PERCENT) -> str:
    """What sets of sizes n and o that link fulfil at their first common shingle, which stands at
    pos in the one and at ``at`` in the other: enough of both must be left from there on, of all
    and of the prefixes' entries that any other group has (s and t of them)."""
    overlap = f"ceil({percent} * (n + o) / {100.0 + percent})"
    return f"100 * least(n, o) >= {percent} * greatest(n, o) AND pos <= n - {overlap} AND at <= o - {overlap} AND least(s, t) >= {in_prefixes(percent)}"


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    full = signatures(docs)
    sign = written(full.drop("prefix", "bits"), "digests")  # what is needed to the end
    known = full.where("doc_id IS NOT NULL AND n > 0")
    of_set = written(known.groupBy("g", "n", "a", "b").agg(F.min(F.struct("doc_id", "bits")).alias("s")).select("g", "n", "a", "b", F.col("s.doc_id").alias("cid"), F.col("s.bits").alias("bits")), "classes")
    classes = of_set.drop("bits")

    # 1. the index of groups; one exchange. An entry goes unless another group of a size that can
    # link has the shingle: of the sizes in order, the nearest. Rows of one group stand together
    # (its first row sees what is below it, its last one what is above). Entries of frequent
    # shingles are dealt into parts, which see no neighbours beyond them; they all stay
    size, pos, hot = F.shiftright("at", 32), F.shiftright("at", 1).bitwiseAND(0x7FFFFFFF), F.col("at").bitwiseAND(1) == 1
    entries = known.where("prefix IS NOT NULL").select("g", "n", "rare", F.posexplode("prefix").alias("pos", "h"))
    entries = entries.select("h", "g", (F.shiftleft("n", 32) + 2 * F.col("pos") + (F.col("pos") >= F.col("rare")).cast("int")).alias("at")).withColumn("n", size)
    entries = entries.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("g"), F.lit(SALTS))).otherwise(0))
    same = Window.partitionBy("h", "salt").orderBy("n", "g")
    near = entries.withColumns({"rank": F.row_number().over(same), "n0": F.lag("n").over(same), "n_min": F.first("n").over(same), "g0": F.lag("g").over(same), "n1": F.lead("n").over(same), "g1": F.lead("g").over(same)})
    near = near.where(hot | F.expr(f"(g0 <> g AND 100 * n0 >= {PERCENT} * n) OR (g1 <> g AND 100 * n >= {PERCENT} * n1)"))
    # what stands too far back to be the first common shingle with even the smallest partner finds
    # no pairs; it only counts in the lists
    smallest = F.greatest(F.when(hot, 0).otherwise(F.col("n_min")), F.ceil(PERCENT * F.col("n") / 100))
    first = pos <= F.col("n") - F.ceil(PERCENT * (F.col("n") + smallest) / (100.0 + PERCENT))
    index = near.groupBy("h", "salt", "g", "at").agg(F.max((F.col("rank") > PIVOTS) | hot).alias("many"), F.max(first).alias("first"))
    # 2. groups expand; a group of several classes meets in itself, in an entry of its own. Not more
    # than PIVOTS entries of a shingle are not marked as one of many
    classes_of = classes.withColumn("k", F.count("*").over(Window.partitionBy("g")))
    entry = F.struct(pos.alias("pos"), "h", (F.col("many") | (F.col("k") > 1)).alias("many"), "first")
    own = F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.col("g").alias("h"), (F.col("k") > PIVOTS).alias("many"), F.lit(True).alias("first")))
    lists = classes_of.join(index, "g", "left").where("h IS NOT NULL OR k > 1").groupBy("g", "cid", "n", "k").agg(F.collect_list(F.when(F.col("h").isNotNull(), entry)).alias("entries"))
    lists = written(lists.select("g", "cid", "n", F.when(F.col("k") > 1, F.concat(F.sort_array("entries"), own)).otherwise(F.sort_array("entries")).alias("entries")), "lists")
    discard(full)

    # 3. pivots, then what is left
    placed = lists.select("g", "cid", "n", F.size("entries").alias("s"), F.posexplode("entries").alias("r", "e")).where("e.first")
    shared = F.when(F.col("e.h") == F.col("g"), F.col("n")).otherwise(F.col("s") - F.col("r"))  # from there on; of one group, all is shared
    placed = placed.select("e.h", "e.pos", "cid", "n", "e.many", shared.alias("s"), F.col("cid").alias("c"))
    sketches = of_set.select(F.col("cid").alias("doc_id"), "n", "bits")
    done, table = None, (first_ := placed)
    # the first pivot has its shared shingles first, as the text that copies were made of; what it
    # does not connect is tried with others, which are random, among the marked entries: what is
    # not marked makes with the others of its shingle no more than PIVOTS pairs for each of them.
    # Ranks are cut before the exchange too
    for order, most, of in ((F.col("pos"), 1, "true"), (F.xxhash64("cid"), PIVOTS - 1, "many")):
        tried = placed.where(of)
        ranked = tried.withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy(order, "cid")))
        pivots = ranked.where(F.col("k") <= most).select("h", F.col("cid").alias("p"), F.col("n").alias("o"), F.col("pos").alias("at"), F.col("s").alias("t"), F.col("c").alias("d"))
        pairs = tried.join(pivots, "h").where(f"c <> d AND {alike()}").select(F.least("cid", "p").alias("u"), F.greatest("cid", "p").alias("v")).distinct()
        new = verify(pairs if done is None else pairs.join(done, ["u", "v"], "left_anti"), lists, sketches, docs)
        done = new if done is None else done.unionByName(new)
        root = components(done.where("linked").select("u", "v")).withColumnRenamed("id", "cid")
        placed = written(table.drop("c").join(root, "cid", "left").select("h", "pos", "cid", "n", "many", "s", F.coalesce("root", "cid").alias("c")), "placed")
        if table is not first_:
            discard(table)
        table = placed
    most = placed.groupBy("h", "c").count().groupBy("h").agg(F.max(F.struct("count", "c")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("h", F.col("most.c").alias("most"))
    placed = written(placed.join(most, "h"), "placed")
    discard(table)
    few = placed.where("c <> most").select("h", F.col("cid").alias("p"), F.col("n").alias("o"), F.col("pos").alias("at"), F.col("s").alias("t"), F.col("c").alias("d"))
    left = few.join(placed, "h").where(f"c <> d AND {alike()} AND (c = most OR cid < p)").select(F.least("cid", "p").alias("u"), F.greatest("cid", "p").alias("v")).distinct()
    left = left.join(done, ["u", "v"], "left_anti")
    new = verify(left, lists, sketches, docs)
    discard(placed, lists)
    links = done.unionByName(new).where("linked").select("u", "v")
    copies = sign.where("doc_id IS NOT NULL AND n > 0").join(classes, ["g", "n", "a", "b"]).where("doc_id <> cid").select(F.col("doc_id").alias("u"), F.col("cid").alias("v"))
    root = components(links.unionByName(copies)).withColumnRenamed("id", "doc_id")
    return sign.select("doc_id", F.col("n").alias("n_shingles")).join(root, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u
), c AS (
  SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id FROM s JOIN c USING (doc_id)
"""
