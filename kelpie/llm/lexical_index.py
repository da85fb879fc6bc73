"""Ranked lexical search over a clustered index whose documents are reordered by recursive graph bisection.

Building. A tree of bisections is fitted on a bounded sample of documents, as Dhulipala et al. (2016) bisect a graph of
documents and terms: a half of a node's documents is exchanged, pair by pair, while that shortens the gaps between the
postings of its terms. Every document then follows the tree: at each node it goes to the half whose postings it
lengthens less. The leaves, each in order of document length, are cut into shards of some thousand documents, however
many copies a leaf holds. A shard is one row of the index: its documents, and for each term of it the postings.

Searching. A shard's bound for a query is the sum of its terms' largest contributions there. Queries visit their shards
in rounds, by falling bound, and stop when no shard left has a bound that reaches their k-th best score; one that equals
it is still visited, as its document may have the smaller doc_id. So the ranking is exact, and shards that can't matter
aren't scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpie.llm.common import Scratch, in_slices, prepare
from kelpie.llm.shingles import TERM, U, blocks, mix, text_buffers, word_hashes

#: Documents that the bisection is fitted on, about; terms of a document that it looks at, those of the least hash;
#: buckets of terms that it tells apart.
SAMPLE, SKETCH, BUCKETS = 1 << 14, 256, 1 << 13
#: Fewest sampled documents of a leaf, most levels, exchanges at a node.
LEAF, LEVELS, ROUNDS = 64, 8, 8
#: Documents of a shard: at least, at most, about.
SMALL, LARGE = 256, 4096
#: Classes of document length, four to each doubling.
LENGTHS = 256
#: Terms of queries that are searched together at most; beyond that there are several searches.
TOGETHER = 1 << 21
#: Shards that a query visits in the first round, and how many times as many it has visited after each further one.
FIRST, MORE = 8, 4


def counted(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges i to j of texts: words of each text, and for each text and distinct term of it the text's place from i, the term's hash, and how often it occurs, by place and hash."""
    data, offsets = text_buffers(texts)
    for i, j in blocks(offsets):
        h, at = word_hashes(data, offsets[i : j + 1], TERM)
        n = np.diff(at)
        doc = np.repeat(np.arange(j - i), n)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(first)
        yield i, j, n, doc[at], h[at], np.diff(np.r_[at, len(h)])


def _bucket(term: np.ndarray) -> np.ndarray:
    return ((term >> U(24)) & U(BUCKETS - 1)).astype(np.int64)


def _sketched(doc: np.ndarray, term: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The SKETCH terms of the least hash of each document."""
    starts = np.searchsorted(doc, np.arange(m))
    keep = np.arange(len(doc)) - starts[doc] < SKETCH
    return doc[keep], _bucket(term[keep])


@dataclass
class Tree:
    """Bisections of a complete binary tree: for each node the weights of buckets and the sum above which a document goes right."""

    levels: int
    weights: np.ndarray
    cuts: np.ndarray

    def leaves(self, doc: np.ndarray, bucket: np.ndarray, m: int) -> np.ndarray:
        """The leaf of each of m documents, whose sketches are given."""
        node = np.zeros(m, np.int64)
        for _ in range(self.levels):
            total = np.bincount(doc, self.weights[node[doc], bucket], m)
            node = 2 * node + 1 + (total > self.cuts[node])
        return node - (2**self.levels - 1)


def _bits(d: np.ndarray, n: int) -> np.ndarray:
    """About the bits that gaps between d postings among n documents take."""
    return d * np.log2(max(n, 1) / (d + 1))


def _bisection(doc: np.ndarray, bucket: np.ndarray, m: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights and cut of one node with m documents, and for each of these whether it goes right."""
    right = np.arange(m) >= m // 2
    n = (int((~right).sum()), int(right.sum()))

    def degrees() -> tuple[np.ndarray, np.ndarray]:
        side = right[doc]
        return np.bincount(bucket[~side], minlength=BUCKETS), np.bincount(bucket[side], minlength=BUCKETS)

    for _ in range(ROUNDS):
        a, b = degrees()
        now = _bits(a, n[0]) + _bits(b, n[1])
        to_right = now - _bits(np.maximum(a - 1, 0), n[0]) - _bits(b + 1, n[1])
        to_left = now - _bits(a + 1, n[0]) - _bits(np.maximum(b - 1, 0), n[1])
        gain = np.bincount(doc, np.where(right[doc], to_left[bucket], to_right[bucket]), m)
        left_, right_ = np.flatnonzero(~right), np.flatnonzero(right)
        left_, right_ = left_[np.argsort(-gain[left_], kind="stable")], right_[np.argsort(-gain[right_], kind="stable")]
        k = min(len(left_), len(right_))
        better = int((gain[left_[:k]] + gain[right_[:k]] > 1e-9).sum())
        if not better:
            break
        right[left_[:better]], right[right_[:better]] = True, False
    a, b = degrees()
    weights = ((_bits(a + 1, n[0]) - _bits(a, n[0])) - (_bits(b + 1, n[1]) - _bits(b, n[1]))).astype(np.float32)
    total = np.bincount(doc, weights[bucket], m)
    cut = float(np.median(total))
    return weights, cut, total > cut


def fit(sketches: list[np.ndarray]) -> Tree:
    """The tree of a sample of documents, each given by the buckets of its sketch."""
    m = len(sketches)
    levels = min(LEVELS, max(0, (m // LEAF).bit_length() - 1))
    weights, cuts = np.zeros((2**levels - 1, BUCKETS), np.float32), np.full(2**levels - 1, np.inf)
    sizes = np.array([len(s) for s in sketches], np.int64)
    ends, every = np.cumsum(sizes), np.concatenate(sketches) if m else np.zeros(0, np.int64)
    todo = [(0, np.arange(m))]
    while todo:
        node, own = todo.pop()
        if node >= len(cuts) or len(own) < 2:
            continue
        n = sizes[own]
        doc = np.repeat(np.arange(len(own)), n)
        at = np.arange(len(doc)) + np.repeat(ends[own] - n - (np.cumsum(n) - n), n)
        weights[node], cuts[node], right = _bisection(doc, every[at], len(own))
        todo += [(2 * node + 1, own[~right]), (2 * node + 2, own[right])]
    return Tree(levels, weights, cuts)


@dataclass
class Layout:
    """Where documents of a leaf and a class of length go: the leaf's first shard, how many documents of it are shorter, and how many there are."""

    size: int
    first: np.ndarray
    shorter: np.ndarray
    count: np.ndarray

    def shards(self, leaf: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
        c = length_class(n)
        place = self.shorter[leaf, c] + (key % np.maximum(self.count[leaf, c], 1).astype(U)).astype(np.int64)
        return self.first[leaf] + place // self.size


def length_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(4 * np.log2(np.maximum(n, 1)), LENGTHS - 1).astype(np.int64)


def layout(leaves: int, counts: list[tuple[int, int, int]]) -> Layout:
    """counts: rows (leaf, class, documents)."""
    count = np.zeros((leaves, LENGTHS), np.int64)
    for leaf, c, n in counts:
        count[leaf, c] = n
    size = int(np.clip(-(-count.sum() // leaves), SMALL, LARGE))
    own = -(-count.sum(1) // size)
    return Layout(size, np.cumsum(own) - own, np.cumsum(count, 1) - count, count)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, _, doc, term, _ in counted(batch.column(0)):
            d, b = _sketched(doc, term, j - i)
            cuts = np.searchsorted(d, np.arange(1, j - i))
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.uint16).tobytes() for x in np.split(b, cuts)], pa.binary())], names=["sketch"])


def _counts(tree):
    """Texts to rows (leaf, class, docs, words), a few for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        docs = np.zeros(2**t.levels * LENGTHS, np.int64)
        words = docs.copy()
        for batch in batches:
            for i, j, n, doc, term, _ in counted(batch.column(0)):
                at = t.leaves(*_sketched(doc, term, j - i), j - i) * LENGTHS + length_class(n)
                np.add.at(docs, at, n > 0)
                np.add.at(words, at, n)
        at = np.flatnonzero(docs)
        yield pa.RecordBatch.from_arrays([pa.array((at // LENGTHS).astype(np.int32)), pa.array((at % LENGTHS).astype(np.int32)), pa.array(docs[at]), pa.array(words[at])], names=["leaf", "class", "docs", "words"])

    return run


def _filed(tree, plan, wanted):
    """Rows (doc_id, text) to rows (shard, doc_id, n, terms, tfs); terms that aren't wanted are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, p, only = tree.value, plan.value, None if wanted is None else wanted.value
        # a document's place in its task spreads copies and rows without a doc_id; a task that runs again reads the same rows
        seen = (TaskContext.get().partitionId() << 40) if TaskContext.get() else 0
        for batch in batches:
            for i, j, n, doc, term, tf in counted(batch.column(1)):
                m = j - i
                leaf = t.leaves(*_sketched(doc, term, m), m)
                shard = p.shards(leaf, n, mix(np.arange(seen, seen + m, dtype=np.int64).view(U)))
                seen += m
                if only is not None and len(term):
                    hit = np.searchsorted(only, term)
                    hit[hit == len(only)] = 0
                    keep = only[hit] == term if len(only) else np.zeros(len(term), bool)
                    doc, term, tf = doc[keep], term[keep], tf[keep]
                cuts = np.searchsorted(doc, np.arange(m + 1))
                full = np.flatnonzero(n > 0)
                raw, times = term.tobytes(), tf.astype(np.int32).tobytes()
                cut = cuts.tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[full]), batch.column(0).slice(i, m).take(pa.array(full)), pa.array(n[full]), pa.array([raw[8 * cut[k] : 8 * cut[k + 1]] for k in full.tolist()], pa.binary()), pa.array([times[4 * cut[k] : 4 * cut[k + 1]] for k in full.tolist()], pa.binary())],
                    names=["shard", "doc_id", "n", "terms", "tfs"],
                )

    return run


PARTS = ("ids", "known", "sizes", "terms", "starts", "places", "tfs")
INDEX = "shard long, docs int, " + ", ".join(f"{p} binary" for p in PARTS)


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _filed, sorted by shard and n, to rows of the index."""
    own: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        rows = pa.Table.from_batches(own)
        sizes = rows.column("n").to_numpy()
        terms, tfs = (rows.column(c).combine_chunks() for c in ("terms", "tfs"))
        count = np.array([len(x) // 8 for x in terms.to_pylist()], np.int64)
        term, tf = np.frombuffer(b"".join(terms.to_pylist()), U), np.frombuffer(b"".join(tfs.to_pylist()), np.int32)
        place = np.repeat(np.arange(len(sizes), dtype=np.int32), count)
        order = np.argsort(term, kind="stable")
        term, tf, place = term[order], tf[order], place[order]
        at = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        ids = rows.column("doc_id")
        parts = (ids.fill_null(0).to_numpy().astype(np.int64), ids.is_valid().to_numpy(), sizes.astype(np.int64), term[at], np.r_[at, len(term)].astype(np.int32), place, tf)
        return pa.RecordBatch.from_arrays([pa.array([rows.column("shard")[0].as_py()], pa.int64()), pa.array([len(sizes)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["shard", "docs", *PARTS])

    for batch in batches:
        shard = batch.column(0).to_numpy()
        cuts = np.flatnonzero(shard[1:] != shard[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
            if b > a:
                if own and own[-1].column(0)[0].as_py() != int(shard[a]):
                    yield flush()
                    own.clear()
                own.append(batch.slice(a, b - a))
    if own:
        yield flush()


@dataclass
class Index:
    """rows: the table of shards; n and words: documents with a term, and all their words; shards: their number at most; complete: whether all terms are in it."""

    rows: DataFrame
    n: int
    words: int
    shards: int
    complete: bool


def build(spark: SparkSession, docs: DataFrame, scratch: Scratch, wanted: np.ndarray | None = None) -> Index:
    """The index of docs (doc_id, text), written to scratch; of the wanted terms' postings only, if these are given, sorted.

    Texts are read three times: for the sample, for the counts that lay out the shards, and for the postings. These are
    shuffled once.
    """
    context = spark.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    part = min(1 << 30, -(-SAMPLE * (1 << 30) // max(docs.count(), 1)))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < part).select("text").transform(in_slices, _sketches, "sketch binary").limit(2 * SAMPLE)
    tree = context.broadcast(fit([np.frombuffer(r.sketch, np.uint16).astype(np.int64) for r in sample.collect()]))
    counts = docs.select("text").transform(in_slices, _counts(tree), "leaf int, class int, docs long, words long").groupBy("leaf", "class").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).collect()
    plan = layout(2**tree.value.levels, [(r["leaf"], r["class"], r["docs"]) for r in counts])
    filed = docs.transform(in_slices, _filed(tree, context.broadcast(plan), None if wanted is None else context.broadcast(wanted)), "shard long, doc_id long, n long, terms binary, tfs binary")
    rows = scratch.save(filed.repartition("shard").sortWithinPartitions("shard", "n").transform(in_slices, _invert, INDEX), "index")
    return Index(rows, sum(r["docs"] for r in counts), sum(r["words"] for r in counts), int(-(-plan.count.sum(1) // plan.size).sum()), wanted is None)


def _views(batch: pa.RecordBatch, i: int) -> dict[str, np.ndarray]:
    kinds = {"ids": np.int64, "known": bool, "sizes": np.int64, "terms": U, "starts": np.int32, "places": np.int32, "tfs": np.int32}
    return {p: np.frombuffer(batch.column(p)[i].as_buffer(), kinds[p]) for p in PARTS}


def contributions(tf: np.ndarray, n: np.ndarray, total: int, words: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m), m = 100 - 50 + (50 n N) div L."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * (50 + (50 * n * total) // max(words, 1)))


def _asked(wanted, total: int, words: int):
    """Rows of the index to rows (shard, term, docs, most) of the wanted terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                v = _views(batch, i)
                if not len(v["terms"]):
                    continue
                at = np.flatnonzero(np.isin(v["terms"], wanted.value, assume_unique=True))
                most = np.maximum.reduceat(contributions(v["tfs"], v["sizes"][v["places"]], total, words), v["starts"][:-1])[at]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), batch.column("shard")[i].as_py())), pa.array(v["terms"][at].view(np.int64)), pa.array(np.diff(v["starts"])[at].astype(np.int64)), pa.array(most)], names=["shard", "term", "docs", "most"])

    return run


def _scores(weights, total: int, words: int, k: int):
    """Rows of the index with those queries that visit them, as arrays item and floor, to the k best rows (item, doc_id, score, shard, place) of each; none under the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = weights.value
        for batch in batches:
            for i in range(batch.num_rows):
                v = _views(batch, i)
                value = contributions(v["tfs"], v["sizes"][v["places"]], total, words)
                ids, known = v["ids"], v["known"]
                found = []
                for item, floor in zip(batch.column("item")[i].as_py(), batch.column("floor")[i].as_py(), strict=True):
                    terms, ws = of[item]
                    at = np.searchsorted(v["terms"], terms)
                    at[at == len(v["terms"])] = 0
                    hit = v["terms"][at] == terms if len(v["terms"]) else np.zeros(len(terms), bool)
                    at, ws = at[hit], ws[hit]
                    a, n = v["starts"][at].astype(np.int64), np.diff(v["starts"])[at].astype(np.int64)
                    every = np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)
                    score = np.zeros(len(ids), np.int64)
                    np.add.at(score, v["places"][every], np.repeat(ws, n) * value[every])
                    good = np.flatnonzero(score >= floor)
                    if len(good) > k:
                        good = good[score[good] >= np.partition(score[good], -k)[-k]]
                        good = good[np.lexsort((good, ids[good], ~known[good], -score[good]))[:k]]
                    found.append((np.full(len(good), item), ids[good], known[good], score[good], good))
                item, id_, ok, score, place = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(id_, mask=~ok), pa.array(score), pa.array(np.full(len(item), batch.column("shard")[i].as_py())), pa.array(place.astype(np.int64))], names=["item", "doc_id", "score", "shard", "place"])

    return run


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, _, doc, term, _ in counted(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(term.view(np.int64))], names=["item", "term"])


def _search(scratch: Scratch, index: Index, asked: DataFrame, terms: DataFrame, k: int, tag: str, visits: list | None) -> DataFrame:
    """The k best rows (item, doc_id, score, shard, place) of each item of terms (item, term), whose shards' terms are asked."""
    context = scratch.spark.sparkContext
    df = asked.groupBy("term").agg(F.sum("docs").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * index.n + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = scratch.save(terms.join(df, "term").select("item", "term", weight.alias("w")).where("w > 0"), f"{tag}-weights")
    own: dict[int, tuple[list, list]] = {}
    for r in weighed.toLocalIterator():
        x = own.setdefault(r.item, ([], []))
        x[0].append(r.term)
        x[1].append(r.w)
    weights = context.broadcast({i: (np.array(t, np.int64).view(U), np.array(w, np.int64)) for i, (t, w) in own.items()})
    bounds = asked.join(weighed, "term").groupBy("item", "shard").agg(F.sum(F.col("w") * F.col("most")).alias("bound"))
    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "shard")
    bounds = scratch.save(bounds.where("bound > 0").withColumn("rank", F.row_number().over(by_bound)), f"{tag}-bounds")
    schema = "item long, doc_id long, score long, shard long, place long"
    best = scratch.save(scratch.spark.createDataFrame([], schema), f"{tag}-best")
    done, upto, step = 0, FIRST, 0
    while True:
        floors = best.groupBy("item").agg(F.count("*").alias("held"), F.min("score").alias("least")).select("item", F.when(F.col("held") >= k, F.col("least")).otherwise(F.lit(1)).alias("floor"))
        left = bounds.where(F.col("rank") > done).join(floors, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(1).cast("long"))).where("bound >= floor")
        now = scratch.save(left.where(F.col("rank") <= upto).select("shard", "item", "floor"), f"{tag}-visits{step}")
        if visits is not None:
            visits.append(now.count())
        if now.isEmpty() and (upto >= index.shards or left.isEmpty()):
            return best
        visited = now.groupBy("shard").agg(F.collect_list("item").alias("item"), F.collect_list("floor").alias("floor"))
        found = index.rows.join(visited, "shard").transform(in_slices, _scores(weights, index.n, index.words, k), schema)
        top = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "shard", "place")
        both = best.unionByName(found).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).drop("rank")
        step += 1
        old, best = best, scratch.save(both, f"{tag}-best{step}")
        done, upto = upto, upto * MORE


def ranked(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 50, visits: list | None = None, complete: bool = False) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the k best documents of docs (doc_id, text) for each row of items (item_id, text).

    Terms and scores as the contract of op12 says, in whole numbers; equal scores go by ascending doc_id, documents
    without a doc_id last. Null texts and texts without a term are never found and find nothing. Rows of docs that repeat
    a doc_id are documents of their own; a row of items that comes twice is answered twice, under its item_id, null too.
    Other columns are ignored; whole texts are read on both sides. Empty tables give no rows.

    Where the items have at most TOGETHER terms, postings of other terms are not written, as they can't score; else, or
    with complete, the index has all terms and the items are searched in several parts. visits, if given, gets the number
    of pairs of an item and a shard that each round has scored.
    """
    prepare(spark)
    scratch = Scratch(spark, "lexical")
    items = scratch.save(items.select(F.col("item_id").alias("item_id"), "text").withColumn("item", F.monotonically_increasing_id()), "items")
    terms = scratch.save(items.where("text is not null").select("item", "text").transform(in_slices, _terms, "item long, term long"), "terms")
    parts = -(-max(terms.count(), 1) // TOGETHER)
    of = lambda p: terms if parts == 1 else terms.where(F.pmod("item", F.lit(parts)) == p)
    vocabulary = lambda t: np.sort(np.array([r.term for r in t.select("term").distinct().toLocalIterator()], np.int64).view(U))
    index = build(spark, docs, scratch, None if complete or parts > 1 else vocabulary(terms))
    out = []
    for p in range(parts):
        wanted = spark.sparkContext.broadcast(vocabulary(of(p)))
        asked = scratch.save(index.rows.transform(in_slices, _asked(wanted, index.n, index.words), "shard long, term long, docs long, most long"), f"{p}-asked")
        out.append(_search(scratch, index, asked, of(p), k, str(p), visits))
    best = out[0]
    for more in out[1:]:
        best = best.unionByName(more)
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "shard", "place")
    return best.withColumn("rank", F.row_number().over(place)).join(items.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
