"""Whitening, ranked search and license scans against brute force, and the cases each docstring defines."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

try:
    from re import _parser as sre
except ImportError:
    import sre_parse as sre

from kelpie.llm import lexical_index, license_scan, shingles, whitening
from kelpie.llm.common import Scratch

DATA = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


# ---- whitening


def fitted(vectors):
    """n, sums, x, components and their variances by numpy, and exact deviations by Python's whole numbers."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in x])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    return n, y, v, e[::-1], u[:, ::-1], [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]


def test_whitening(spark):
    rng = np.random.default_rng(5)
    good = (rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) + 50).tolist()
    bad = [(900, None), (901, []), (902, [1.0, None] + [0.0] * 38), (903, [NAN] * 40), (904, [INF] + [0.0] * 39), (905, [1e300] * 40)]
    rows = [(i, v) for i, v in enumerate(good)] + [(7, good[7]), (None, good[8])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + bad], "vec_id long, embedding array<double>, component int, n string").repartition(5)
    got = whitening.whiten(spark, df).collect()
    n, y, v, e, u, deviations = fitted([v for _, v in rows])
    assert Counter(r.vec_id for r in got) == Counter({i: 32 * k for i, k in Counter(i for i, _ in rows).items()})
    assert {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 33))
    assert len({r.identity_error for r in got}) == 1 and 0 < got[0].identity_error < 1e-9
    of = {i: k for k, (i, _) in enumerate(rows)}
    for r in got:
        k, c = of[r.vec_id], r.component - 1
        assert r.deviation == deviations[k]
        assert abs(abs(r.whitened) - abs(y[k] @ u[:, c] / math.sqrt(e[c]))) < 1e-7
        assert abs(r.explained - e[c] / np.trace(v)) < 1e-9
    sign = {}
    for r in got:
        k, c = of[r.vec_id], r.component - 1
        if abs(r.whitened) > 1e-3:
            assert sign.setdefault(c, np.sign(r.whitened * (y[k] @ u[:, c]))) == np.sign(r.whitened * (y[k] @ u[:, c]))


def test_whitening_of_few_and_mixed(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 3.0]), (3, [5.0]), (4, [7.0]), (5, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    got = {(r.vec_id, r.component): r for r in whitening.whiten(spark, df).collect()}
    assert len(got) == 2 * 2 + 2 + 3
    assert [got[i, 1].whitened for i in (1, 2)] == [-1.0, 1.0] and got[1, 2].whitened is None and got[1, 2].explained == 0
    assert sorted(got[i, 1].whitened for i in (3, 4)) == [-1.0, 1.0] and got[5, 1].n == 1 and got[5, 1].whitened is None and got[5, 1].deviation == 0
    assert got[1, 1].identity_error < 1e-12
    assert whitening.whiten(spark, df.limit(0)).collect() == []
    assert whitening.whiten(spark, df.select("vec_id", "embedding").where("vec_id = 3")).collect()[0].whitened is None


def test_whitening_merges_exactly():
    rng = np.random.default_rng(1)
    x = rng.integers(10**9, 10**9 + 50, (1000, 6))
    parts = [whitening.state(x[a:b]) for a, b in ((0, 1), (1, 400), (400, 1000))]
    s = parts[2].merged(parts[0]).merged(parts[1])
    y = x - x.mean(0)
    assert s.n == 1000 and s.sums == [int(c) for c in x.sum(0)]
    assert np.allclose(s.scatter, y.T @ y, rtol=1e-12, atol=1e-6)


def test_deviation_beyond_a_long():
    s = whitening.State(2**31, [0, 2**31], np.eye(2))
    m = whitening.model(s, 2)
    assert m.deviations(np.array([[3, 1], [2**30, 1]])) == [(3 * 2**31) ** 2 if (3 * 2**31) ** 2 < 2**63 else None, None]


# ---- ranked search


def best(docs, items, k=50):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w = [words(t) for _, t in docs]
    total, every = sum(1 for x in w if x), sum(map(len, w))
    df = Counter(t for x in w for t in set(x))
    tfs = [Counter(x) for x in w]
    out = []
    for item, text in items:
        scores = []
        for r, tf in enumerate(tfs):
            m = 100 - 50 + ((50 * len(w[r]) * total) // max(every, 1))
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in set(words(text)) if tf[t])
            if s > 0:
                scores.append((-s, docs[r][0] is None, docs[r][0] or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus(spark):
    own = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    odd = [(5001, None), (5002, ""), (5003, "--- !!"), (5004, own[3][1]), (5004, own[3][1]), (None, own[4][1]), (5005, "the " * 30_000), (5006, "Été ÉTÉ été naïve\x00the"), (5007, "w" * 2000 + " the")]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").limit(12).collect()]
    return own + odd, items + [(100, None), (101, ""), (102, "the"), (102, "the"), (None, "été"), (103, own[3][1]), (104, "unheardofword"), (105, "w" * 2000)]


@pytest.mark.parametrize(("k", "complete", "together"), [(50, False, 1 << 21), (5, True, 1 << 21), (5, False, 300)])
def test_ranked(spark, corpus, k, complete, together, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(lexical_index, "SMALL", 16)
    monkeypatch.setattr(lexical_index, "LARGE", 16)
    monkeypatch.setattr(lexical_index, "TOGETHER", together)
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score long, shard int").repartition(3)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    visits = []
    got = lexical_index.ranked(spark, d, i, k, visits, complete).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=repr) == best(docs, items, k)
    assert sum(visits) < len(items) * len(docs) / 16 or together == 300


def test_ranked_stops_early(spark):
    """Documents on one topic make shards of their own; others aren't visited."""
    rng = random.Random(2)
    topics = [[f"t{k}w{j}" for j in range(30)] for k in range(16)]
    docs = [(i, " ".join(rng.choices(topics[i % 16], k=40))) for i in range(6000)]
    items = [(k, " ".join(topics[k][:6])) for k in range(16)]
    visits = []
    df = lambda rows, a: spark.createDataFrame(rows, f"{a} long, text string")
    got = lexical_index.ranked(spark, df(docs, "doc_id"), df(items, "item_id"), 10, visits).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=repr) == best(docs, items, 10)
    index = lexical_index.build(spark, df(docs, "doc_id"), Scratch(spark, "t"))
    print("visited", visits, "of", 16 * index.shards)
    assert sum(visits) < 0.5 * 16 * index.shards


def test_ranked_without_rows(spark):
    d, i = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert lexical_index.ranked(spark, d.limit(0), i).collect() == [] and lexical_index.ranked(spark, d, i.limit(0)).collect() == []
    assert [r.score for r in lexical_index.ranked(spark, d, i).collect()] == [s for *_, s in best([(1, "a b")], [(1, "b")])]


def test_bisection_parts_topics():
    rng = np.random.default_rng(0)
    sketches = [np.sort(rng.choice(40, 20, replace=False)) + 100 * (i % 2) for i in range(400)]
    tree = lexical_index.fit(sketches)
    doc = np.repeat(np.arange(400), 20)
    leaves = tree.leaves(doc, np.concatenate(sketches), 400)
    assert tree.levels == 2 and all(not set(leaves[::2]) & {x} for x in set(leaves[1::2]))
    assert lexical_index.fit([]).levels == 0 and lexical_index.fit([np.array([1])] * 200).leaves(np.arange(2), np.array([1, 1]), 2).tolist() == [0, 0]


def test_layout_splits_copies():
    plan = lexical_index.layout(2, [(0, 3, 5000), (1, 8, 10)])
    assert plan.size == 2505
    shard = plan.shards(np.zeros(5000, np.int64), np.full(5000, 2), np.arange(5000).astype(np.uint64))
    assert Counter(shard.tolist()) == {0: 5000} or max(Counter(shard.tolist()).values()) <= 2 * plan.size
    assert plan.shards(np.array([1]), np.array([4]), np.array([7], np.uint64)).tolist() == [2]


def test_words_have_their_own_hashes():
    """Pairs that hashes by polynomials of an odd base modulo 2^64 mistake, zero bytes, and words of every length."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    words = [a, a.translate(str.maketrans("ab", "ba")), "x", "x\x00", "\x00x", "x\x00\x00"] + ["y" * n for n in range(1, 200)] + ["z" * n + "q" for n in range(1, 100)]
    h, at = shingles.word_hashes(*shingles.text_buffers(pa.array([" ".join(words)])))
    assert len(h) == len(words) == len(set(h.tolist()))
    one, two = shingles.shingle_sets(pa.array(words[:2]))
    assert one != two
    assert shingles.word_hashes(*shingles.text_buffers(pa.array(["ABC abc LONGER-WORD longer-word É é"])))[0].tolist()[0::2][:2] == shingles.word_hashes(*shingles.text_buffers(pa.array(["abc longer-word"])))[0].tolist()


# ---- license scans


def scanned(text, rules=license_scan.RULES):
    """All rules at all of their keywords in the whole text, and suppression over all pairs."""
    w = re.findall(license_scan.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    low = (text or "").lower()
    found = []
    if any(g in low for g in license_scan.GATES) or re.search(r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by", low):
        for i, r in enumerate(rules):
            for p in (k for k, x in enumerate(w) if x == r.keyword):
                m = re.search(f"(?<![^ ]){r.pattern}(?![^ ])", " ".join([*w[:p], ">" + w[p], *w[p + 1 :]]))
                if m:
                    start = p - m[0].split(">")[0].count(" ")
                    found.append((r.priority, -m[0].count(" "), i, start, start + m[0].count(" "), r))
    kept = [d for d in found if not any(e[3] <= d[3] and e[4] >= d[4] and e[:3] < d[:3] for e in found)]
    places = [(k, label) for phrase, label in license_scan.BASE for k in range(len(w)) if w[k : k + phrase.count(" ") + 1] == phrase.split()]
    starts, base = [k for k, _ in places], {label for _, label in places}
    score = max([0.0, *(d[5].score for d in kept), *([0.8] if base else [])])
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {d[5].label for d in kept})), score


def sample(pattern, rng):
    """A text that a pattern matches."""

    def one(op, arg):
        if op is sre.LITERAL:
            return chr(arg)
        if op is sre.IN:
            return rng.choice("0123456789") if arg[0][0] is sre.CATEGORY and "DIGIT" in str(arg[0][1]) else "word" if arg[0][0] is sre.CATEGORY else chr(rng.choice([x[1] for x in arg if x[0] is sre.LITERAL]))
        if op is sre.SUBPATTERN:
            return every(arg[3])
        if op is sre.BRANCH:
            return every(rng.choice(arg[1]))
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            return "".join(every(arg[2]) for _ in range(rng.randint(arg[0], min(int(arg[1]), arg[0] + 8))))
        raise ValueError(op)

    every = lambda p: "".join(one(op, arg) for op, arg in p)
    return every(sre.parse(pattern)).replace(">", "")


def test_every_rule_is_found(spark):
    """An example of each rule, within words, and several together, are scanned as brute force does."""
    rng = random.Random(4)
    rules = license_scan.RULES
    assert len(rules) > 400 and not license_scan.clash()
    examples = [sample(r.pattern, rng) for r in rules]
    assert all(e.count(" ") <= license_scan.AROUND for e in examples)
    texts = [f"Words before {e.title() if i % 3 else e} -- license. after" for i, e in enumerate(examples)]
    texts += [" ".join(rng.choices(examples, k=12)) + " licence" for _ in range(60)]
    texts += [re.sub(" ", lambda m: rng.choice([" ", "-", ", ", "\n"]), t) for t in texts[-60:]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    cols = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    for r in license_scan.scan(rows).collect():
        assert tuple(r[c] for c in cols) == scanned(texts[r.doc_id]), texts[r.doc_id]
        assert r.doc_id >= len(rules) or rules[r.doc_id].label in r.labels.split(",") or any(d.last - d.start >= examples[r.doc_id].count(" ") for d in r.detections)


def test_scan_of_odd_rows(spark):
    texts = [None, "", "CC BY cc-by; MIT LICENSE mit license", "mité license", "Apache  License\n" * 3, "İ MIT License K", "apache license " * 2000, "license " * 5000, "xcc by", "cc\tby", "acc by-law cc by"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, texts[2])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_words int, labels string")
    got = license_scan.scan(df).collect()
    cols = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert Counter((r.doc_id, *(r[c] for c in cols)) for r in got) == Counter((i, *scanned(t)) for i, t in rows)
    assert license_scan.scan(df.limit(0)).collect() == []


def test_stronger_rules_suppress(spark):
    texts = {0: "under the GNU General Public License, version 3 or later", 1: "Licensed under CC BY-NC 4.0", 2: "GNU Lesser General Public License v2.1", 3: "SPDX-License-Identifier: BSD-3-Clause OR license"}
    got = {r.doc_id: r.labels for r in license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {0: "gpl,gpl-3.0-or-later", 1: "cc-by,cc-by-nc-4.0", 2: "lgpl-2.1", 3: "bsd-3-clause"}


def test_scan_has_no_shuffle_and_no_python(spark):
    plan = license_scan.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
