"""Mixing sources to target weights by subset sums over the histogram of document sizes.

A source takes all its documents as many whole times as its target allows; what is left of the target is a subset sum
over its sizes. Each size first gives its proportional share of all but some words; a bounded knapsack (a bit set of
reachable sums, one layer for each size) fills the rest as closely as any choice can, and gets more words where that
isn't close enough. All this sees only counts by
source and exact size. Which documents of a size are taken is decided by a seeded hash, with counts of hash buckets, so that no size,
however frequent, is ranked in one task.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpie.llm.common import Scratch, prepare

WORDS = r"[^\x20\x09-\x0D]++"
#: Words left over at first for the exact knapsack, bits of all its sets at most (64 MB), and documents in a hash bucket.
REST, BITS, BUCKET = 1 << 13, 1 << 29, 1024


def shares(totals: list[tuple[str | None, int]], most: int = 3) -> dict[str | None, float]:
    """Targets: all words by weights 1, 2, 3 in code-point order (null last), none over `most` times its source's size."""
    order = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: i % 3 + 1 for i, (s, _) in enumerate(order)}
    size, left, out = dict(order), float(sum(n for _, n in order)), {}
    while len(out) < len(order):
        unit = left / sum(weight[s] for s in size if s not in out)
        over = [s for s in size if s not in out and weight[s] * unit > most * size[s]]
        if not over:
            out |= {s: weight[s] * unit for s in size if s not in out}
        for s in over:
            out[s] = float(most * size[s])
            left -= out[s]
    return out


def _order(seed: int, size: int) -> bytes:
    return hashlib.blake2b(f"{seed}:{size}".encode(), digest_size=8).digest()


def subset(counts: dict[int, int], want: int, seed: int) -> dict[int, int]:
    """How many documents of each size to take, for a sum as near to want as any of those that complete a proportional part.

    The knapsack has REST words at first, and twice as many as long as no choice meets the target and its bit sets stay
    under BITS; where it has the whole target, no sum is nearer.
    """
    total = sum(k * n for k, n in counts.items())
    if want <= 0 or not total:
        return {}
    if want >= total:
        return dict(counts)
    sizes = sorted(counts, key=lambda k: _order(seed, k))
    layers = sum(n.bit_length() for n in counts.values())
    rest, best, off = REST, {}, want + 1
    while off and (rest == REST or rest * layers <= BITS):
        took = _completed(counts, sizes, want, total, rest)
        missed = abs(want - sum(k * n for k, n in took.items()))
        if missed < off:
            best, off = took, missed
        if rest >= want:
            break
        rest *= 2
    return best


def _completed(counts: dict[int, int], sizes: list[int], want: int, total: int, rest: int) -> dict[int, int]:
    """A proportional part of all but `rest` words of want, and the best subset for what is left."""
    took = {k: n * max(want - rest, 0) // total for k, n in counts.items()}
    left = want - sum(k * n for k, n in took.items())
    for k in sizes:
        if left <= rest:
            break
        n = min(counts[k] - took[k], left // k)
        took[k] += n
        left -= n * k
    room = left + min(left, max((k for k in sizes if counts[k] > took[k]), default=0))
    keep, layers, reach = (1 << (room + 1)) - 1, [], 1
    for k in sizes:
        n, step = min(counts[k] - took[k], room // k), 1
        while n > 0:  # binary parts of a bounded count
            m = min(step, n)
            layers.append((k, m, reach))
            reach |= (reach << (k * m)) & keep
            n, step = n - m, 2 * step
        if reach >> left & 1:
            break
    low = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    over = reach >> left
    high = left + (over & -over).bit_length() - 1 if over else room + 1
    at = high if high <= room and high - left < left - low else low
    for k, m, before in reversed(layers):
        if not before >> at & 1:
            took[k] += m
            at -= k * m
    return took


def _planned(targets: dict, seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(rows["size"].tolist(), rows["n"].tolist(), strict=True))
        total, target = sum(k * n for k, n in counts.items()), round(targets[key[0]])
        whole = target // total if total else 0
        took = subset({k: n for k, n in counts.items() if k}, target - whole * total, seed) if total else {}
        return pd.DataFrame({"key": key[0], "size": list(counts), "n": list(counts.values()), "source_size": total, "target": targets[key[0]], "whole": whole, "x": [took.get(k, 0) for k in counts]})

    return run


def mix(spark: SparkSession, docs: DataFrame, seed: int = 0) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken) for docs (doc_id, text, source), one for each row.

    size: words of the whole text, 0 for null. taken: size times the repeats, of which there are at most 3. Rows that
    repeat a doc_id are documents of their own, spread by their texts; a null source is a source. Other columns are ignored. The driver gets
    one row for each source.
    """
    prepare(spark)
    scratch = Scratch(spark, "mix")
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    sized = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id"), "text").alias("h")), "sized")
    hist = sized.groupBy("key", "size").agg(F.count("*").alias("n"))
    totals = hist.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("n")).collect()
    named = {(r.key[1:] if r.key else None): r.n for r in totals}
    targets = {("" if s is None else "=" + s): t for s, t in shares(list(named.items())).items()} if totals else {}
    plan = scratch.save(hist.groupBy("key").applyInPandas(_planned(targets, seed), "key string, size long, n long, source_size long, target double, whole long, x long"), "plan")
    rows = sized.join(plan, ["key", "size"]).withColumn("b", F.pmod("h", F.ceil(F.col("n") / BUCKET)))
    counts = rows.where("x > 0 and x < n").groupBy("key", "size", "b").agg(F.count("*").alias("m"), F.max("x").alias("x"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("key", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = counts.withColumn("share", F.greatest(F.lit(0), F.least(F.col("m"), F.col("x") - before))).select("key", "size", "b", "m", "share")
    rows = rows.join(cut, ["key", "size", "b"], "left").select("doc_id", "key", "size", "source_size", "target", "whole", "h", "b", F.expr("case when x = 0 then 0 when x = n then 1 when share = 0 then 0 when share = m then 1 end").alias("more"), "share")
    split = rows.where("more is null").withColumn("k", F.row_number().over(Window.partitionBy("key", "size", "b").orderBy("h", "doc_id")))
    done = rows.where("more is not null").unionByName(split.withColumn("more", (F.col("k") <= F.col("share")).cast("int")).drop("k"))
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("more"))).alias("taken"), (F.col("whole") + F.col("more")).cast("int").alias("repeats"))
