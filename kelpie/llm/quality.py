"""Quality scores by a sparse rule ensemble (Friedman and Popescu, 2008).

Statistics of a text are Spark expressions. Small boosted trees over them give rules: a rule is the conjunction of the
conditions on a path from a root. A lasso logistic regression weighs the rules and drops most; those left are compiled
to one Spark column, so scoring stays in the JVM and needs no shuffle.

The trees and weights are fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import prepare

#: Statistics: name and SQL over columns t (text, not null), n (its length, at least 1), w (its words, at least 1), l (its lines).
STATS = {
    "chars": "ln(n)",
    "words": "ln(size(w))",
    "word_chars": "n / size(w)",
    "distinct_words": "size(array_distinct(w)) / size(w)",
    "line_words": "size(w) / size(l)",
    "distinct_lines": "size(array_distinct(l)) / size(l)",
    "upper": r"regexp_count(t, '\\p{Lu}') / n",
    "digits": "(n - length(translate(t, '0123456789', ''))) / n",
    "symbols": "(n - length(translate(t, '#$%&*@^~<>{}[]/=+_', ''))) / n",
    "marks": "(n - length(translate(t, '!?', ''))) / n",
    "bars": "(n - length(replace(t, '|', ''))) / n",
    "stops": "(n - length(translate(t, '.,;:', ''))) / n",
    "short_words": "size(filter(w, x -> length(x) <= 3)) / size(w)",
    "long_words": "size(filter(w, x -> length(x) > 12)) / size(w)",
}


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns keep and STATS of column text; a null text counts as empty."""
    t = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("t"))
    t = t.select(*keep, "t", F.expr("greatest(length(t), 1)").alias("n"), F.expr(r"split(t, '[\\x20\\x09-\\x0D]++')").alias("w"), F.expr("split(t, '\n')").alias("l"))
    return t.select(*keep, *(F.expr(f"cast({sql} as double)").alias(name) for name, sql in STATS.items()))


@dataclass
class Rules:
    """Conjunctions of (statistic, is it over, threshold) and their weights; score = 1 / (1 + exp(-sum))."""

    rules: list[tuple[tuple[str, bool, float], ...]]
    weights: list[float]
    start: float

    def column(self) -> Column:
        total = F.lit(self.start)
        for rule, w in zip(self.rules, self.weights, strict=True):
            on = F.lit(True)
            for name, over, at in rule:
                on = on & ((F.col(name) > at) if over else (F.col(name) <= at))
            total = total + F.when(on, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def score(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.start + holds(x, names, self.rules) @ np.array(self.weights))))


def holds(x: np.ndarray, names: list[str], rules: list) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for name, over, at in rule:
            v = x[:, names.index(name)]
            out[:, j] *= v > at if over else v <= at
    return out


def _paths(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], names: list[str], g: np.ndarray, rows: np.ndarray, depth: int, leaf: int, path: tuple, out: list, fit: np.ndarray) -> None:
    """Grows a tree on gradients g; all paths go to out, the leaves' means to fit."""
    best, where = 1e-9, None
    if depth and len(rows) >= 2 * leaf:
        total, n = g[rows].sum(), len(rows)
        for f in range(x.shape[1]):
            k = len(cuts[f]) + 1
            if k < 2:
                continue
            s = np.cumsum(np.bincount(bins[rows, f], g[rows], k))[:-1]
            c = np.cumsum(np.bincount(bins[rows, f], minlength=k))[:-1]
            ok = (c >= leaf) & (n - c >= leaf)
            gain = np.where(ok, s**2 / np.maximum(c, 1) + (total - s) ** 2 / np.maximum(n - c, 1) - total**2 / n, 0)
            b = int(gain.argmax())
            if gain[b] > best:
                best, where = gain[b], (f, b)
    if where is None:
        fit[rows] = g[rows].mean()
        return
    f, b = where
    for over in (False, True):
        side = rows[(bins[rows, f] > b) == over]
        rule = (*path, (names[f], over, float(cuts[f][b])))
        out.append(rule)
        _paths(x, bins, cuts, names, g, side, depth - 1, leaf, rule, out, fit)


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 800) -> np.ndarray:
    """The start and weights that minimise the mean logistic loss plus penalty times the weights' absolute sum, by FISTA."""
    p = float(y.mean())
    one = np.c_[np.ones(len(a)), a]
    step = 4 * len(a) / max(float(np.linalg.norm(one.T @ one, 2)), 1e-9)
    w = v = np.r_[np.log(p / (1 - p)), np.zeros(a.shape[1])]
    t = 1.0
    for _ in range(rounds):
        grad = one.T @ (1 / (1 + np.exp(-(one @ v))) - y) / len(a)
        new = v - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / nt * (new - w), new, nt
    return w


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, leaf: int = 15, penalty: float = 2e-4, seed: int = 7) -> Rules:
    """Rules from boosted trees, each on half of the rows, and their lasso weights by FISTA."""
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Rules([], [], float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 49))) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    p = float(y.mean())
    z = np.full(len(y), np.log(p / (1 - p)))
    rules: list = []
    for _ in range(trees):
        g, fitted, own = y - 1 / (1 + np.exp(-z)), np.zeros(len(y)), []
        rows = np.sort(rng.permutation(len(y))[: max(len(y) // 2, min(len(y), 4 * leaf))])
        _paths(x, bins, cuts, names, g, rows, depth, leaf, (), own, fitted)
        rules += own
        # the tree's values for all rows, from its leaves
        leaves = [r for r in own if not any(o[: len(r)] == r and len(o) > len(r) for o in own)]
        on = holds(x, names, leaves)
        value = np.array([g[v > 0].mean() / max(1e-3, p * (1 - p)) if (v > 0).any() else 0 for v in on.T])
        z += 0.3 * (on @ value if len(leaves) else 0)
    rules = list(dict.fromkeys(tuple(sorted(set(r))) for r in rules))
    a = holds(x, names, rules)
    keep = [j for j in range(len(rules)) if 0 < a[:, j].mean() < 1]
    rules, a = [rules[j] for j in keep], a[:, keep]
    w = lasso(a, y, penalty)
    on = np.flatnonzero(np.abs(w[1:]) > 1e-6)
    return Rules([rules[j] for j in on], [float(w[1 + j]) for j in on], float(w[0]))


def learn(docs: DataFrame, labels: DataFrame, most: int = 10_000) -> Rules:
    """From documents (doc_id, text) and labels (doc_id, quality): about `most` labelled documents at most, by a hash.

    A document labelled more than once counts with the rounded mean of its labels; null labels don't count. The sampled
    labels are broadcast, as their number is bounded, so texts are not shuffled. The share that is sampled is `most` of
    all labels, so those of documents that are not to be learnt from are left out before.
    """
    own = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg("quality")).alias("y"))
    n = own.count()
    own = own.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(n, 1))))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(own), "doc_id")
    rows = statistics(picked, ["doc_id", "y"]).orderBy("doc_id").collect()
    x = np.array([[r[c] for c in STATS] for r in rows]).reshape(-1, len(STATS))
    return fit(x, np.array([float(r.y) for r in rows]), list(STATS))


def scored(spark: SparkSession, stats: DataFrame, rules: Rules, least: float = 0.3) -> DataFrame:
    """Statistics with score and predicted (1 if score >= least); rows are neither dropped nor joined."""
    prepare(spark)
    return stats.withColumn("score", rules.column()).withColumn("predicted", (F.col("score") >= least).cast("int"))
