"""Language identification of whole and mixed texts.

A word's letters fall into scripts by ranges of code points; only languages that are written in its script are
candidates. A word's score under a language is its log likelihood over hashed character n-grams of up to 3 with word
ends. Viterbi over the words, with a penalty for each switch of language, labels spans. A text's language is the one
that labels most of its letters; its score is the share of letters so labelled, times the odds of those words' scores
against the next language, as a probability. That compares languages only, so a model may also hold how well its
learning documents fit; texts that fit none of its languages are then left undetermined.

The n-gram tables are fitted on a bounded sample of documents and have a fixed size for each language.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import in_slices, prepare
from kelpie.llm.shingles import U, mix

WORD = re.compile(r"[^\W\d_]+")
#: First code points of script ranges and the scripts' names.
SCRIPTS = [(0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"), (0xA80, "gujarati"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"), (0xE00, "thai"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other")]
NAMES = sorted({s for _, s in SCRIPTS})
_STARTS = np.array([a for a, _ in SCRIPTS])
_OF = np.array([NAMES.index(s) for _, s in SCRIPTS])
BUCKETS, PENALTY, FAR = 1 << 17, 12.0, -40.0
CACHE = 400_000
#: Buckets in a row of counts.
CHUNK = 1 << 14
SHARE = 0.02
#: How far a text's mean log likelihood per n-gram may lie under the lower quartile of its language's learning documents:
#: SLACK, and for few n-grams NOISE / sqrt(n) more. SCRIPT: least share of letters in words of the language's scripts.
SLACK, NOISE, SCRIPT = 1.75, 6.0, 0.5


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of ^word$, where each word's begin, and each word's script (that of most letters; ties: the first)."""
    text = "".join(f"\x02{w}\x03" for w in words)
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U)
    n = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(n)
    starts = ends - n
    k = U(0x9E3779B97F4A7C15)
    one = mix(c + U(1) * k)
    two, three = np.zeros_like(one), np.zeros_like(one)
    two[:-1] = mix(one[:-1] * U(3) + c[1:] + k)
    three[:-2] = mix(two[:-2] * U(5) + c[2:] + k)
    all3 = np.stack([one, two, three], 1) & U(BUCKETS - 1)
    all3 += (np.arange(3, dtype=U) * U(BUCKETS))[None]
    ok = np.ones(all3.shape, bool)
    ok[starts, 0] = ok[ends - 1, 0] = False  # word ends alone say nothing
    ok[ends - 1, 1] = False
    ok[ends - 1, 2] = ok[ends - 2, 2] = False
    cum = np.concatenate([[0], np.cumsum(ok.sum(1))])
    letters = _OF[np.searchsorted(_STARTS, c.astype(np.int64), "right") - 1]
    one_hot = np.zeros((len(c), len(NAMES)), np.int32)
    inside = np.ones(len(c), bool)
    inside[starts] = inside[ends - 1] = False
    one_hot[np.flatnonzero(inside), letters[inside]] = 1
    script = np.add.reduceat(one_hot, starts, 0).argmax(1) if len(words) else np.zeros(0, int)
    return all3[ok].astype(np.int64), cum[starts], script


class Model:
    """langs; table[bucket, lang] of log likelihoods; may[script, lang]; low[lang], the learning documents' lower quartile of fit, or None."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        """counts: n-grams by bucket and language; scripts: letters by script and language."""
        self.langs = langs
        self.table = np.empty(counts.shape, np.float32)
        for i in range(len(langs)):
            by_order = counts[:, i].reshape(3, BUCKETS).astype(np.float64)
            self.table[:, i] = np.log((by_order + 0.05) / (by_order.sum(1, keepdims=True) + 0.05 * 4096)).ravel()
        self.may = scripts >= SHARE * np.maximum(scripts.sum(0, keepdims=True), 1)
        self.low: np.ndarray | None = None
        self.key = uuid.uuid4().hex

    def fits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: its log likelihood under each language, its n-grams, and which languages are written in its script."""
        g, at, script = grams(words)
        return np.add.reduceat(self.table[g], at, 0), np.diff(np.r_[at, len(g)]), self.may[script]

    def scores(self, words: list[str]) -> np.ndarray:
        """Of each word under each language, at most 0: what it lacks to the best candidate."""
        g, at, script = grams(words)
        s = np.add.reduceat(self.table[g], at, 0) / 2
        may = self.may[script]
        s = np.where(may | ~may.any(1, keepdims=True), s, -np.inf)
        return np.maximum(s - s.max(1, keepdims=True), FAR).astype(np.float32)


def viterbi(s: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The labels of a best path; ties go to the smaller label, and to staying.

    The best single label is the path if no other label gains more than half a penalty on it over any stretch of words:
    a path's departure in m runs of other labels costs m - 1 switches at least, and m if the label is met at either end.
    """
    n, k = s.shape
    best = int(s.sum(0, dtype=np.float64).argmax())
    run = np.zeros((n + 1, k))
    np.cumsum(s - s[:, best : best + 1], 0, dtype=np.float64, out=run[1:])
    if k == 1 or (run[1:] - np.minimum.accumulate(run[:-1], 0)).max() <= penalty / 2:
        return np.full(n, best)
    back, score = np.empty((n, k), np.int8 if k < 128 else np.int32), s[0].astype(np.float64)
    stay = np.arange(k)
    rows = s.tolist() if k <= 8 else None
    if rows is not None:  # few languages: plain Python beats numpy's calls
        v, path = list(map(float, rows[0])), []
        for row in rows[1:]:
            m = max(v)
            b = v.index(m)
            m -= penalty
            path.append([b if m > x else -1 for x in v])
            v = [(m if m > x else x) + y for x, y in zip(v, row, strict=True)]
        at = v.index(max(v))
        out = np.empty(n, np.int64)
        out[-1] = at
        for i in range(n - 2, -1, -1):
            b = path[i][at]
            at = at if b < 0 else b
            out[i] = at
        return out
    for i in range(1, n):
        b = int(score.argmax())
        jump = score[b] - penalty > score
        back[i] = np.where(jump, b, stay)
        score = np.where(jump, score[b] - penalty, score) + s[i]
    out = np.empty(n, np.int64)
    out[-1] = score.argmax()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i][out[i]]
    return out


class Labeller:
    """Labels texts, with a cache of word scores."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.s = np.zeros((1 << 16, len(self.model.langs)), np.float32)
        self.n = np.zeros(1 << 16, np.int64)
        self.fit, self.grams, self.ok = np.zeros_like(self.s), np.zeros_like(self.n), np.zeros(self.s.shape, bool)

    def index(self, words: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(self.at) > CACHE:
                self.clear()
            new = list({w for w in words if w not in self.at})
            a, b = len(self.at), len(self.at) + len(new)
            while b > len(self.n):
                self.s, self.n = np.concatenate([self.s, np.zeros_like(self.s)]), np.concatenate([self.n, np.zeros_like(self.n)])
                if self.model.low is not None:
                    self.fit, self.grams, self.ok = (np.concatenate([x, np.zeros_like(x)]) for x in (self.fit, self.grams, self.ok))
            self.s[a:b] = self.model.scores(new)
            if self.model.low is not None:
                self.fit[a:b], self.grams[a:b], self.ok[a:b] = self.model.fits(new)
            self.n[a:b] = [sum(map(str.isalpha, w)) for w in new]
            self.at.update(zip(new, range(a, b), strict=True))
            return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def label(self, text: str | None) -> tuple[str, float, list[str], np.ndarray]:
        words = WORD.findall(text.lower()) if text else []
        k = self.index(words) if words else np.zeros(0, np.int64)
        n = self.n[k]
        total = int(n.sum())
        if not total or not self.model.langs:
            return "und", 0.0, words, np.zeros(0, np.int64)
        path = viterbi(self.s[k])
        by = np.bincount(path, n, len(self.model.langs))
        best = int(by.argmax())
        if self.model.low is not None and not self._known(k, path, best, n, total):
            return "und", 0.0, words, path
        own = self.s[k[path == best]].sum(0, dtype=np.float64)
        margin = own[best] - np.delete(own, best).max() if len(own) > 1 else np.inf
        return self.model.langs[best], float(by[best] / total / (1 + np.exp(-max(margin, 0.0)))), words, path

    def _known(self, k: np.ndarray, path: np.ndarray, best: int, letters: np.ndarray, total: int) -> bool:
        """Whether the words are in scripts of their languages, and fit them as learning documents do."""
        ok = self.ok[k, path]
        if letters[ok].sum() < SCRIPT * total:
            return False
        n = self.grams[k[ok]].sum()
        return self.fit[k[ok], path[ok]].sum(dtype=np.float64) / n >= self.model.low[best] - SLACK - NOISE / np.sqrt(n)


_labellers: dict = {}


def _labeller(m: Model) -> Labeller:
    """The worker's labeller of a model, which keeps its cache from task to task."""
    key = (m.key, m.low is None or m.low.tobytes())
    if key not in _labellers:
        _labellers.clear()
        _labellers[key] = Labeller(m)
    return _labellers[key]


def _labelled(model, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        own = _labeller(m)
        for batch in batches:
            pred, score, found = [], [], []
            for t in batch.column(0).to_pylist():
                lang, p, words, path = own.label(t)
                pred.append(lang)
                score.append(p)
                if spans:
                    cut = np.flatnonzero(np.r_[True, path[1:] != path[:-1]]) if len(path) else np.zeros(0, np.int64)
                    found.append([{"first": int(a), "words": int(b), "lang": m.langs[path[a]]} for a, b in zip(cut, np.diff(np.r_[cut, len(path)]), strict=len(path) > 0)])
            cols = [*batch.columns[1:], pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            names = [*batch.schema.names[1:], "lang_pred", "score"]
            if spans:
                cols.append(pa.array(found, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _tallied(langs: list[str]):
    """Rows (lang, text) to rows (lang, chunk, places, counts): the n-grams of a task's texts by bucket, and its letters by script (chunk -1)."""
    number = {lang: i for i, lang in enumerate(langs)}

    def flush(i: int, seen: Counter) -> Iterator[pa.RecordBatch]:
        words = list(seen)
        total, scripts = np.zeros(3 * BUCKETS, np.int64), np.zeros(len(NAMES), np.int64)
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            g, at, script = grams(part)
            times = np.array([seen[w] for w in part])
            np.add.at(total, g, np.repeat(times, np.diff(np.r_[at, len(g)])))
            np.add.at(scripts, script, times * np.array([len(w) for w in part]))
        found = [(-1, scripts), *enumerate(total.reshape(-1, CHUNK))]
        found = [(k, np.flatnonzero(x), x) for k, x in found if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i] * len(found), pa.int32()), pa.array([k for k, _, _ in found], pa.int32()), pa.array([p.astype(np.int32) for _, p, _ in found], pa.list_(pa.int32())), pa.array([x[p] for _, p, x in found], pa.list_(pa.int64()))], names=["lang", "chunk", "places", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = seen.setdefault(number[lang], Counter())
                own.update(WORD.findall(text.as_py().lower()))
                if len(own) > CACHE:
                    yield from flush(number[lang], own)
                    own.clear()
        for i, own in seen.items():
            if own:
                yield from flush(i, own)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, chunk, places, counts) of all tasks, added up by (lang, chunk); a task holds its own chunks only."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for lang, chunk, places, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            own = total.setdefault((lang, chunk), np.zeros(CHUNK, np.int64))
            own[places.values.to_numpy()] += counts.values.to_numpy()
    keys = list(total)
    places = [np.flatnonzero(total[k]).astype(np.int32) for k in keys]
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array(places, pa.list_(pa.int32())), pa.array([total[k][p] for k, p in zip(keys, places, strict=True)], pa.list_(pa.int64()))], names=["lang", "chunk", "places", "counts"])


def _means(model):
    """Rows (lang, text) to rows (lang, mean): the mean log likelihood per n-gram of a text under its own language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _labeller(model.value)
        for batch in batches:
            langs, means = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                i = own.model.langs.index(lang)
                k = own.index(WORD.findall(text.as_py().lower()))
                k = k[own.ok[k, i]]
                if n := int(own.grams[k].sum()):
                    langs.append(lang)
                    means.append(float(own.fit[k, i].sum(dtype=np.float64) / n))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(means, pa.float64())], names=["lang", "mean"])

    return run


def fit(learn: DataFrame, each: int = 1500, reject: bool = False) -> Model:
    """From rows (doc_id, text, lang): about `each` documents of a language at most, picked by a hash of doc_id.

    The n-grams are counted where the texts are; the driver gets at most 3 * BUCKETS counts of a language, as large as
    the model it builds. reject: texts that fit no language, by likelihood or script, will be 'und'.
    """
    spark = learn.sparkSession
    prepare(spark)
    learn = learn.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((3 * BUCKETS, 0)), np.zeros((len(NAMES), 0)))
    share = F.create_map(*(F.lit(x) for lang in langs for x in (lang, int(1_000_000 * min(1.0, each / sizes[lang])))))
    picked = learn.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(share, F.col("lang"))).select("lang", "text")
    schema = "lang int, chunk int, places array<int>, counts array<long>"
    counts, scripts = np.zeros((3 * BUCKETS, len(langs)), np.float32), np.zeros((len(NAMES), len(langs)))
    for r in picked.transform(in_slices, _tallied(langs), schema).repartition("lang", "chunk").transform(in_slices, _added, schema).collect():
        into, base = (scripts, 0) if r.chunk < 0 else (counts, r.chunk * CHUNK)
        into[np.array(r.places) + base, r.lang] = r.counts
    model = Model(langs, counts, scripts)
    if reject:
        model.low = np.full(len(langs), -np.inf)
        means = picked.transform(in_slices, _means(spark.sparkContext.broadcast(model)), "lang string, mean double")
        for r in means.groupBy("lang").agg(F.percentile("mean", 0.25).alias("low")).collect():
            model.low[langs.index(r.lang)] = r.low
    return model


def identify(spark: SparkSession, docs: DataFrame, model: Model, keep: list[str] | None = None, spans: bool = False) -> DataFrame:
    """Rows (*keep, lang_pred, score) and, if asked for, spans array<struct<first, words, lang>> by word number.

    lang_pred is 'und' with score 0 for null texts, texts without a letter and those a model with `reject` rejects. Rows are neither dropped nor joined.
    Texts are read whole; a column named text may be kept too.
    """
    prepare(spark)
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(F.col("text").alias("_text"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    more = ", spans array<struct<first:int,words:int,lang:string>>" if spans else ""
    return rows.transform(in_slices, _labelled(spark.sparkContext.broadcast(model), spans), f"{fields}, lang_pred string, score double{more}")
