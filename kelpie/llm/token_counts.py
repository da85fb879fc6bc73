"""Token counts of a sentencepiece BPE model by a two-tier map-side lookup of pre-token lengths.

No piece of the model has a space marker behind another character, nor a newline, so no merge crosses the beginning of
a run of spaces or a newline: a text falls into pre-tokens whose numbers of tokens add up. Both are checked when the
model is loaded; a model without the property is applied to whole texts.

First tier: lengths of the most frequent pre-tokens of all texts, broadcast (at most `frequent` entries, so of bounded
size). Second tier: each worker encodes misses once and keeps them in a cache of at most CACHE entries. No text's
pre-tokens are shuffled: the frequent ones come from one pass over all texts in which a task keeps a bounded sketch of
counts, and only these sketches, one row a task with up to SKETCH pre-tokens, are sent and merged in a tree. They decide
what is looked up first, not what is counted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import in_slices, prepare

PRETOKEN = re.compile(r"\n| *[^ \n]+| +")
CACHE, LONG = 1 << 20, 64
#: Pre-tokens in a task's sketch, and tasks that merge sketches before the last one.
SKETCH, FAN = 1 << 13, 32
_models: dict = {}
_caches: dict = {}


def model(path: str):
    """The model, and whether texts may be cut at runs of spaces and newlines."""
    if path not in _models:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = [i for i in range(len(pieces)) if sp.is_control(i) or sp.is_unknown(i)]
        apart = not any("▁" in p.lstrip("▁") or ("\n" in p and len(p) > 1) for i, p in enumerate(pieces) if i not in special)
        apart = apart and sp.encode(" a  b", out_type=str) == ["▁", "▁a", "▁", "▁b"] and sp.encode("\n\n")[:-1] == sp.encode("\n")
        _models[path] = sp, apart
    return _models[path]


def lengths(path: str, keys: list[str]) -> list[int]:
    """Tokens of each pre-token where it stands in a text; keys begin with their spaces, if any."""
    sp, _ = model(path)
    bare = [len(k) > 1 and k[0] == " " and k[1] != " " for k in keys]
    # The model puts a space before a text, so " word" is the text "word"; nothing merges with a newline before it.
    got = sp.encode([k[1:] if b else "\n" + k for k, b in zip(keys, bare, strict=True)], num_threads=1)
    base = len(sp.encode("\n"))
    return [len(g) - (0 if b else base) for g, b in zip(got, bare, strict=True)]


def pretokens(text: str) -> list[str]:
    """The pieces of a text; a space marker in it counts as a space, as in the model."""
    return PRETOKEN.findall(" " + (text.replace("▁", " ") if "▁" in text else text)) if text else []


class _Sketch:
    """Counts of the most frequent keys, held for at most 16 times as many as are asked for in the end."""

    def __init__(self, most: int) -> None:
        self.most, self.seen = most, Counter()

    def add(self, keys) -> None:
        self.seen.update(keys)
        if len(self.seen) > 16 * self.most:
            self.seen = Counter(dict(self.top(4 * self.most)))

    def top(self, n: int) -> list[tuple[str, int]]:
        return sorted(self.seen.items(), key=lambda x: (-x[1], x[0]))[:n]

    def row(self) -> pa.RecordBatch:
        top = self.top(self.most)
        return pa.RecordBatch.from_arrays([pa.array([[k for k, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], names=["keys", "counts"])


def _frequent(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Sketch(most)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                own.add([k for k in pretokens(t) if len(k) <= LONG])
        yield own.row()

    return run


def _merged(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Sketch(most)
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own.add(dict(zip(keys, counts, strict=True)))
        yield own.row()

    return run


def frequent_pretokens(docs: DataFrame, most: int) -> list[str]:
    """The most frequent pre-tokens of docs (text), nearly: those frequent in few tasks only may be missed."""
    kinds = "keys array<string>, counts array<long>"
    sketches = docs.select("text").transform(in_slices, _frequent(min(most, SKETCH)), kinds)
    merged = sketches.repartition(FAN).transform(in_slices, _merged(most), kinds).coalesce(1).transform(in_slices, _merged(most), kinds)
    return [k for r in merged.collect() for k in r["keys"]]


def _count(path: str, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, apart = model(path)
        first = table.value
        cache = _caches.setdefault(path, {})
        cache.update(first)
        get = cache.get
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            n_bytes, n_tokens = [], []
            for t in texts:
                if not t:
                    n_bytes.append(0)
                    n_tokens.append(0)
                    continue
                n_bytes.append(len(t.encode()))
                if not apart:
                    n_tokens.append(len(sp.encode(t)))
                    continue
                keys = pretokens(t)
                try:
                    n_tokens.append(sum(map(cache.__getitem__, keys)))
                except KeyError:
                    if len(cache) > CACHE:
                        cache.clear()
                        cache.update(first)
                    new = list({k for k in keys if k not in cache})
                    got = dict(zip(new, lengths(path, new), strict=True))
                    n_tokens.append(sum(got[k] if (v := get(k)) is None else v for k in keys))
                    cache.update(got if all(len(k) <= LONG for k in new) else {k: v for k, v in got.items() if len(k) <= LONG})
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(spark: SparkSession, docs: DataFrame, path: str, limit: int = 4096, frequent: int = 1 << 15) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each row of docs (doc_id, text).

    path: a sentencepiece model, as each worker finds it. Null and empty texts have 0 bytes and tokens; a null doc_id
    stays null; repeated rows are repeated; other columns are ignored. Texts are read whole.
    """
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = frequent_pretokens(docs, frequent)
    table = spark.sparkContext.broadcast(dict(zip(keys, lengths(path, keys), strict=True)) if keys else {})
    out = docs.transform(in_slices, _count(path, table), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
