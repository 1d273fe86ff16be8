"""Quality classifier: a sparse ensemble of rules.

Boosted trees are fitted to labelled documents' statistics; each path from a root to a node is
a rule, a conjunction of comparisons. A logistic regression with an L1 penalty gives most rules
weight 0. The rest is compiled into one Spark column expression, so that scoring is a projection
over the corpus, without Python.

Training sees at most ``sample`` labelled documents, those with the least hashes of their ids
among rows whose crc32(doc_id as text) mod 5 is not 0. Where the hashes have to be cut follows
from how many labelled ids there are, so that no task sees more than its part of the sample;
statistics of that many rows go to the driver. Labels, language, source and id are no inputs
of a score.

Cases: null and empty texts have statistics of 0 and are scored like any; a null id is scored
and not held out; several labels of one id count as the least, and
of several rows of one id training sees the one with the least hash of its text; without labels of both classes
all documents get the share of class 1 (0.5 without any); an empty table gives an empty one.
Columns in ``carry`` are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.boosting import paths, train
from kinfold.llm.text_stats import add_words, counted, ratio, shares

SAMPLE = 20_000
THRESHOLD = 0.3
FOLDS = 5
PENALTY = 0.001
STEPS = 400


def held_out(folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))


def statistics() -> dict[str, Column]:
    """What is known of a text, over add_words()."""
    n = F.size("_words")
    return shares() | {
        "log_words": F.log1p(n.cast("double")),
        "distinct_share": ratio(F.size(F.array_distinct("_words")), n),
        "line_share": ratio(counted("\n"), n),
        "stop_share": ratio(counted(r"[.,;:]"), n),
        "digit_share": ratio(counted(r"[0-9]"), n),
    }


@dataclass
class RuleEnsemble:
    """score = 1 / (1 + exp(-(bias + sum of the weights of the rules that hold)))."""

    names: list[str]
    bias: float
    rules: list[tuple[tuple[tuple[int, bool, float], ...], float]]

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = None
            for k, above, cut in rule:
                c = F.col(self.names[k])
                part = c > F.lit(cut) if above else c <= F.lit(cut)
                holds = part if holds is None else holds & part
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def rule_matrix(x: np.ndarray, rules: list) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for k, above, cut in rule:
            out[:, j] *= x[:, k] > cut if above else x[:, k] <= cut
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    n, m = r.shape
    a = np.hstack([np.ones((n, 1)), r])
    v = np.ones(m + 1)
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / np.linalg.norm(a.T @ (a @ v))
    w = z = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -35, 35)))
        new = z - step * (a.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / s * (new - w), new, s
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = PENALTY) -> RuleEnsemble:
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()), 0.001), 0.999) if len(y) else 0.5
        return RuleEnsemble(names, float(np.log(p / (1 - p))), [])
    rules = paths(train(x, y, rounds=20, depth=3))
    bias, w = lasso(rule_matrix(x, rules), y, penalty, STEPS)
    return RuleEnsemble(names, bias, [(rules[j], float(w[j])) for j in np.flatnonzero(np.abs(w) > 1e-6)])


def least_hashes(ids: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` of the distinct ids, those of least hash. Hashes are spread evenly, so
    that below ``sample`` / n of their range there are ``sample`` of n ids, give or take some
    roots of that; five roots less, hardly ever more than ``sample``, which the limit still holds."""
    n = ids.count()
    if n <= sample:
        return ids
    cut = max(0.0, sample - 5 * sample**0.5) / n
    return ids.where(F.xxhash64("doc_id") < F.lit(int(-(2**63) + cut * 2**64))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def train_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleEnsemble:
    """The ensemble for a corpus and its labels (doc_id, quality)."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("_y"))
    chosen = least_hashes(chosen, sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    stats = statistics()
    one = add_words(rows).select("doc_id", F.struct(F.xxhash64("doc_id", "text").alias("k"), F.col("_y").cast("double"), *(c.alias(n) for n, c in stats.items())).alias("s"))
    got = sorted(r["s"] for r in one.groupBy("doc_id").agg(F.min("s").alias("s")).collect())
    table = np.array([tuple(r) for r in got], float).reshape(len(got), len(stats) + 2)
    return fit(table[:, 2:], table[:, 1], list(stats))


def classify(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The carried columns, held_out, score and predicted."""
    model = train_on(docs, labels, sample)
    names = {c: f"_carry_{k}" for k, c in enumerate(carry)}
    rows = docs.select(*(F.col(c).alias(n) for c, n in names.items()), held_out().alias("held_out"), "text")
    # exploding an array of the one score keeps a later filter above it: pushed below, the filter
    # would have the whole ensemble, with each statistic, written into it once for each rule
    scored = add_words(rows).withColumns(statistics()).select(*names.values(), "held_out", F.explode(F.array(model.score())).alias("score"))
    return scored.select(*(F.col(n).alias(c) for c, n in names.items()), "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
