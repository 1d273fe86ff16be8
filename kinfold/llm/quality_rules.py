"""Quality rules as weak supervision.

Each rule votes good (2) or bad (1), or abstains (0). How reliable the rules are is not set by
hand: expectation-maximisation over the patterns of votes in the whole corpus estimates, for
good documents and for each kind of bad ones, how often each rule gives each vote; a document's
posterior probability of being good decides. A document is kept if that is at least
``threshold`` and the base test does not fail.

What tells a kind from good documents with one odd feature is that several rules see it: each
of the four kinds has three rules or more of which the votes go together. Nothing else holds
the estimates, but for a prior of ``STRENGTH`` vote for each rule and class, whatever the size of the corpus.

How often each pattern of votes occurs is counted by the cluster and goes to the driver. There
are at most 3 to the number of rules of them, whatever the corpus, and some hundred in practice,
as the rules read related shares (87 in 51,282 documents). The estimates go back as an
expression over a document's votes: no join, and all of the work on documents is DataFrame
expressions.

Cases: a null or empty text has no words and fails the base test; a null id is kept as it is;
equal rows each count; an empty table gives an empty one. Columns in ``carry`` are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.shared import written
from kinfold.llm.text_stats import add_base, add_words, counted, ratio, shares

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
THRESHOLD = 0.5
#: Votes that the prior counts for each rule and class.
STRENGTH = 1.0
#: Rules that name a kind of bad document, where its class begins; the others add to the evidence.
KINDS = ("symbols", "capitals", "pipes", "stutter")
ROUNDS = 100


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(1)).when(good, F.lit(2)).otherwise(F.lit(0))


def evidence() -> dict[str, Column]:
    """Shares that only these rules use, over add_base()."""
    n = F.size("_words")
    part = lambda pattern: ratio(F.size(F.filter("_words", lambda w: w.rlike(pattern))), n)
    return {
        "letter_share": ratio(counted(r"\p{L}"), F.col("word_chars")),
        "mark_share": ratio(F.col("n_symbols"), n),
        "lettered_share": part(r"\p{L}"),
        "capital_share": part(r"^\P{L}*\p{Lu}{2,}\P{L}*$"),
        "distinct_share": ratio(F.size(F.array_distinct("_words")), n),
    }


def rules() -> dict[str, Column]:
    """Votes, from the base counts and shares. A long text repeats its words by nature, so that
    ``distinct`` abstains there."""
    c = F.col
    repeats, lines = ratio(c("n_repeat_words"), c("n_words")), ratio(c("n_dup_lines"), c("n_lines"))
    enough = c("n_words") >= 20
    return {
        "symbols": vote(c("symbol_share") > 0.3, c("symbol_share") < 0.05),
        "capitals": vote(enough & (c("upper_share") > 0.5), c("upper_share") < 0.2),
        "shouts": vote(enough & (c("shout_share") > 0.3), c("shout_share") < 0.05),
        "pipes": vote(c("pipe_share") > 0.1, c("pipe_share") < 0.02),
        "stutter": vote(enough & (c("stutter_share") > 0.3), c("stutter_share") < 0.1),
        "repeats": vote(repeats > 0.2, repeats < 0.05),
        "lines": vote(lines > 0.3, lines < 0.1),
        "short_words": vote((c("n_words") >= 50) & (c("short_share") < 0.03), c("short_share") > 0.1),
        "word_length": vote((c("word_length") < 2) | (c("word_length") > 15), c("word_length").between(3, 12)),
        "letters": vote(c("letter_share") < 0.75, c("letter_share") > 0.9),
        "marks": vote(c("mark_share") > 0.1, c("mark_share") < 0.02),
        "lettered": vote(c("lettered_share") < 0.85, c("lettered_share") > 0.95),
        "capital_words": vote(enough & (c("capital_share") > 0.5), c("capital_share") < 0.1),
        "distinct": vote(c("n_words").between(20, 1000) & (c("distinct_share") < 0.3), (c("n_words") <= 1000) & (c("distinct_share") > 0.45)),
    }


@dataclass
class Estimate:
    """Classes are good and then the kinds: their shares, for each class and rule how often it
    gives each vote, and for each pattern of votes the posterior probability of good."""

    shares: list[float]
    table: list[list[list[float]]]
    good: dict[tuple[int, ...], float]

    def posterior(self, votes: list[Column]) -> Column:
        """The probability of good for a document with these votes."""

        def log_of(c: int) -> Column:
            out = F.lit(math.log(self.shares[c]))
            for v, row in zip(votes, self.table[c], strict=True):
                out = out + F.when(v == 0, math.log(row[0])).when(v == 1, math.log(row[1])).otherwise(math.log(row[2]))
            return out

        good, odds = log_of(0), F.lit(1.0)
        for c in range(1, len(self.shares)):
            odds = odds + F.exp(log_of(c) - good)
        return 1 / odds


def estimate(patterns: list[tuple[tuple[int, ...], int]], kinds: tuple[int, ...] = (), rounds: int = ROUNDS, strength: float = STRENGTH) -> Estimate:
    """The estimate from patterns of votes and how often they occur.

    Bad documents are bad in different ways, and one class for all of them would come to stand
    for the most frequent way alone. So there is a class for good and one for each kind of bad,
    named by a rule (its place is in ``kinds``, all rules if that is empty). A kind begins with
    its rule voting bad mostly, good with rules seldom voting bad; these beginnings also are the
    prior, of ``strength`` votes a rule and class. From there on the votes alone decide."""
    m, total = len(patterns[0][0]) if patterns else 0, sum(n for _, n in patterns)
    kinds = kinds or tuple(range(m))
    begin = [[[0.08, 0.02, 0.9]] * m] + [[[0.05, 0.9, 0.05] if j == k else [0.2, 0.2, 0.6] for j in range(m)] for k in kinds]
    shares_, table, post = [0.8, *[0.2 / max(1, len(kinds))] * len(kinds)], begin, {}
    for _ in range(rounds if patterns else 0):
        post = {}
        for p, _ in patterns:
            logs = [math.log(a) + sum(math.log(t[j][v]) for j, v in enumerate(p)) for a, t in zip(shares_, table, strict=True)]
            odds = [math.exp(x - max(logs)) for x in logs]
            post[p] = [x / sum(odds) for x in odds]
        mass = [sum(n * post[p][c] for p, n in patterns) for c in range(len(begin))]
        shares_ = [(x + 1) / (total + len(begin)) for x in mass]
        counts = [[[strength * x for x in row] for row in rows] for rows in begin]
        for p, n in patterns:
            for c, rows in enumerate(counts):
                for j, v in enumerate(p):
                    rows[j][v] += n * post[p][c]
        table = [[[x / (of + strength) for x in row] for row in rows] for rows, of in zip(counts, mass, strict=True)]
    return Estimate(shares_, table, {p: x[0] for p, x in post.items()})


def quality_rules(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The carried columns, n_words, the base counts, base_failed, p_good and kept."""
    votes = rules()
    names = {c: f"_carry_{k}" for k, c in enumerate(carry)}
    rows = docs.select(*(F.col(c).alias(n) for c, n in names.items()), "text")
    stats = add_base(add_words(rows)).withColumns(shares() | evidence())
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = stats.select(*names.values(), *BASE, failed.alias("base_failed"), F.concat_ws("", *(v.cast("string") for v in votes.values())).alias("_pattern"))
    stats = written(stats, "votes")
    found = [(tuple(map(int, r["_pattern"])), r["n"]) for r in stats.groupBy("_pattern").agg(F.count("*").alias("n")).collect()]
    known = estimate(sorted(found), tuple(list(votes).index(k) for k in KINDS))
    p_good = known.posterior([F.substring("_pattern", j + 1, 1).cast("int") for j in range(len(votes))]) if found else F.lit(0.5)
    kept = ~F.col("base_failed") & (F.col("p_good") >= threshold)
    out = stats.withColumn("p_good", p_good)
    return out.select(*(F.col(n).alias(c) for c, n in names.items()), *BASE, "base_failed", "p_good", F.coalesce(kept, F.lit(False)).alias("kept"))
