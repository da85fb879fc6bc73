"""Best-fit packing of documents into sequences, by bin completion on the histogram of piece lengths.

Pieces of one length are interchangeable, so the packing is found for the histogram alone: at most `capacity` counts
on the driver, whatever the input. Best fit is the first incumbent. Bin completion (Martello and Toth, 1990; Korf,
2003) then completes a sequence around the longest piece left, by each undominated filling of the room behind it and
as often as the counts allow, prunes by the waste that can still beat the incumbent and by a lower bound, and goes
back. A piece then finds its place by its rank among those of its length: its rank in its task, which is written with
it, and the number of such pieces in earlier tasks.
"""

from __future__ import annotations

import json
import logging
import os
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpie.llm.common import Scratch, in_slices, prepare

#: A single space belongs to what follows it and a longer run ends before its last space, so tokens never cross the
#: beginning of a run of spaces: each such part of a text is encoded by itself.
PART = re.compile(r" *[^ ]+| +")
CACHE, LONG = 400_000, 64
#: Fixed value: the words of byte-level BPE.
WORD = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A token the files of this kind have, which stands between parts that are encoded together.
SEPARATOR = "<|endoftext|>"
#: Steps of the search for fewer sequences than best fit takes.
NODES = 20_000
_encoders: dict = {}
LOG = logging.getLogger(__name__)


def _bytes_of() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones as they are, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _fast(path: str):
    """An encoder of many texts at once for byte-level BPE files whose ids are merge ranks; None for other files."""
    spec = json.loads(Path(path).read_text())
    pre, kind = spec.get("pre_tokenizer") or {}, spec["model"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    if kind.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or SEPARATOR not in special:
        return None
    import tiktoken

    of = _bytes_of()
    ranks = {bytes(of[c] for c in k): i for k, i in kind["vocab"].items() if k not in special}
    enc = tiktoken.Encoding(path, pat_str=WORD, mergeable_ranks=ranks, special_tokens=special)
    end = special[SEPARATOR]

    def run(parts: list[str]) -> list[bytes]:
        ids = enc.encode_to_numpy(SEPARATOR.join(parts), allowed_special="all").astype("<u4")
        cut, x = (np.flatnonzero(ids == end) * 4).tolist(), ids.tobytes()
        return [x[i:j] for i, j in zip([0, *(c + 4 for c in cut)], [*cut, len(x)], strict=True)]

    return run


def _encoder(path: str):
    """The tokenizer, a faster encoder of plain parts that gives its ids, and the cache of parts."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        slow = lambda parts: [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(parts, add_special_tokens=False)]
        probe = ["a b", "a  b", "a \n b", "x\n\n y", " \t z ", "it's 10, ", "Äpfel—l'été 日本 🙂\r\n", " \x00\u00a0 x\u3000"]
        for t in probe:
            if b"".join(slow(PART.findall(t))) != slow([t])[0]:
                raise ValueError(f"{path} joins tokens across spaces")
        parts = sorted({k for t in probe for k in PART.findall(t)})
        fast = _fast(path)
        if fast is None or fast(parts) != slow(parts):
            fast = slow
        _encoders[path] = slow, fast, {}
    return _encoders[path]


def encode(path: str, texts: list) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers; parts that no cache has are encoded together."""
    slow, fast, cache = _encoder(path)
    keys = [PART.findall(t) if t else [] for t in texts]
    if len(cache) > CACHE:
        cache.clear()
    new = list(set().union(*keys).difference(cache))
    if new:
        odd = [k for k in new if "<|" in k]
        plain = [k for k in new if "<|" not in k]
        cache.update(zip(plain, fast(plain) if plain else [], strict=True))
        cache.update(zip(odd, slow(odd) if odd else [], strict=True))
    out = [b"".join(map(cache.__getitem__, k)) for k in keys]
    for k in new:
        if len(k) > LONG:
            del cache[k]
    return out


def _cut(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks, tail = TaskContext.get().partitionId(), [0] * (capacity + 1), np.array([end], "<u4").tobytes()
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(texts), 64):
                for doc, x in zip(ids[a : a + 64], encode(path, texts[a : a + 64]), strict=True):
                    x += tail
                    n, start, piece = len(x) // 4, 0, 0
                    while start < n:
                        size = min(n, n % capacity or capacity) if not start else capacity
                        for c, v in zip(cols, (doc, piece, start, size, zlib.crc32(x[4 * start : 4 * (start + size)]), ranks[size]), strict=True):
                            c.append(v)
                        ranks[size] += 1
                        start += size
                        piece += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array([part] * len(cols[0]), pa.int32())], names=["doc_id", "piece", "start", "length", "ids_crc32", "rank", "part"])

    return run


def _reach(sizes: list[int], left: list[int], room: int) -> list[int]:
    """For each i a bit set of the sums up to room that sizes[i:] can have."""
    keep, out = (1 << (room + 1)) - 1, [1]
    for k in reversed(sizes):
        x, n, step = out[-1], min(left[k], room // k), 1
        while n > 0:  # binary parts of a bounded count
            m = min(step, n)
            x |= (x << (k * m)) & keep
            n, step = n - m, 2 * step
        out.append(x)
    return out[::-1]


def _spread(x: int, r: int) -> int:
    """Bits of x and those up to r above each."""
    done = 0
    while done < r:
        step = min(done + 1, r - done)
        x |= x << step
        done += step
    return x


def _dominated(took: list[int], left: list[int], spare: int, waste: int) -> bool:
    """Whether a piece that is left over can take the place of smaller pieces of a filling, or join it.

    spare: a bit set of the sizes that are left. A piece may stand for one smaller piece, or for several that are not
    larger together; the packing that results from the exchange is no worse.
    """
    one = two = 0
    for k in took:
        two |= two << k | one << k
        one |= 1 << k
        if left[k] <= took.count(k):
            spare &= ~(1 << k)
    better = _spread(two, waste)
    if waste:
        better |= _spread(one, waste - 1) << 1 | _spread(1, waste - 1) << 1
    return bool(spare & better)


def fillings(left: list[int], room: int, longest: int, most: int) -> Iterator[tuple[int, list[int]]]:
    """The undominated fillings of room from left with a waste up to most: (waste, lengths, longest first).

    Those of less waste come first, and of equal waste those with the longer pieces. None stands for a filling that was
    dominated, so that whoever counts steps can count it.
    """
    sizes = [k for k in range(min(room, longest), 0, -1) if left[k]]
    reach = _reach(sizes, left, room)
    spare = sum(1 << k for k in sizes)

    def go(i: int, sum_: int) -> Iterator[list[int]]:
        if not sum_:
            yield []
        while sum_ and i < len(sizes) and reach[i] >> sum_ & 1:
            k = sizes[i]
            i += 1
            for n in range(min(left[k], sum_ // k), 0, -1):
                if reach[i] >> (sum_ - n * k) & 1:
                    for rest in go(i, sum_ - n * k):
                        yield [k] * n + rest

    for waste in range(min(most, room) + 1):
        if reach[0] >> (room - waste) & 1:
            for took in go(0, room - waste):
                yield waste, None if _dominated(took, left, spare, waste) else took


def bound(counts: list[int], capacity: int) -> int:
    """A lower bound of the sequences (Martello and Toth's L2): pieces over capacity - t need one each, unshared with those of t and more."""
    n = np.array(counts, np.int64)
    size = n * np.arange(capacity + 1)
    many, total = np.cumsum(n[::-1])[::-1], np.cumsum(size[::-1])[::-1]  # pieces of a length and more, and their sum
    half = capacity // 2 + 1
    t = np.arange(1, half)
    small = total[t] - total[half]  # of t up to half the capacity
    middle, room = many[half] - many[capacity - t + 1], (many[half] - many[capacity - t + 1]) * capacity - (total[half] - total[capacity - t + 1])
    more = -(-np.maximum(small - room, 0) // capacity)
    return int(max((many[capacity - t + 1] + middle + more).max(initial=0), many[half], -(-int(total[1]) // capacity)))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing on the histogram: equal sequences are one entry with a number."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}  # by room left
    for k in sorted((k for k, n in counts.items() if n), reverse=True):
        n = counts[k]
        while n:
            room = min((r for r, x in open_.items() if r >= k and x), default=None)
            if room is None:
                each = capacity // k
                for size, times in ((each, n // each), (n % each, 1)):
                    if size and times:
                        x = open_.setdefault(capacity - k * size, {})
                        x[(k,) * size] = x.get((k,) * size, 0) + times
                break
            got, times = next(iter(open_[room].items()))
            took = min(times, n)
            n -= took
            if took == times:
                del open_[room][got]
            else:
                open_[room][got] -= took
            x = open_.setdefault(room - k, {})
            x[(*got, k)] = x.get((*got, k), 0) + took
    return [(list(got), times) for x in open_.values() for got, times in x.items()]


def plan(counts: dict[int, int], capacity: int, nodes: int = NODES) -> tuple[list[tuple[list[int], int]], int]:
    """Fillings (lengths, longest first) with how many sequences have each, and a lower bound of the sequences.

    Branch and bound over sequences, best fit as the first incumbent. A node gives the longest piece left an undominated
    filling, as often as the counts allow and then less often; fillings of one longest piece are taken in their own
    order, so no set of them is met twice. A branch ends when its waste, or the bound of what is left, can't beat the
    incumbent. The search ends with the fewest sequences there can be, or after `nodes` steps; the bound tells the gap.
    """
    left = [counts.get(k, 0) for k in range(capacity + 1)]
    total = sum(k * n for k, n in enumerate(left))
    least, best = bound(left, capacity), best_fit(counts, capacity)
    fewest = sum(times for _, times in best)
    stack: list[list] = []  # sequences before, waste before, longest, its fillings, the order's key, what it takes, how often

    def descend(used: int, rest: int, after: tuple) -> None:
        """A node for what is left: used sequences are made, rest is the sum of the lengths left."""
        nonlocal best, fewest
        k = next((k for k in range(stack[-1][2] if stack else capacity, 0, -1) if left[k]), 0)
        if not k:
            if used < fewest:
                best, fewest = [(took, times) for *_, took, times in stack], used
            return
        most = (fewest - 1 - used) * capacity - rest
        if most < 0 or used + bound(left, capacity) >= fewest:
            return
        left[k] -= 1
        found = fillings(left.copy(), capacity - k, k, most)
        left[k] += 1
        stack.append([used, rest, k, found, after if stack and stack[-1][2] == k else (), None, 0])

    if least < fewest:
        descend(0, total, ())
    while stack and fewest > least and nodes > 0:
        nodes -= 1
        used, rest, k, found, after, took, times = stack[-1]
        if times:  # once less
            for x in took:
                left[x] += 1
            stack[-1][6] = times = times - 1
        if not times:
            waste, more = next(found, (0, ()))
            if more is None:
                continue
            if more == () or (fewest - 1 - used) * capacity - rest < waste:
                stack.pop()
                continue
            key = (waste, [-x for x in more])
            if after and key <= after:
                continue
            took = [k, *more]
            need = {x: took.count(x) for x in set(took)}
            times = min(left[x] // n for x, n in need.items())
            if waste:
                times = min(times, ((fewest - 1 - used) * capacity - rest) // waste)
            for x, n in need.items():
                left[x] -= n * times
            stack[-1][4:] = [after, took, times]
        descend(used + times, rest - times * sum(took), (capacity - sum(took), [-x for x in took[1:]]))
    return best, least


def _places(filled: list[tuple[list[int], int]], capacity: int) -> np.ndarray:
    """Rows (length << 40 | first rank, first sequence, offset), sorted."""
    ranks, rows, seq = [0] * (capacity + 1), [], 0
    for got, times in filled:
        at = 0
        for k in got:
            rows.append((k << 40 | ranks[k], seq, at))
            ranks[k] += times
            at += k
        seq += times
    return np.array(sorted(rows), np.int64).reshape(-1, 3)


def _place(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for batch in batches:
            key = (batch.column(3).to_numpy() << 40) | batch.column(5).to_numpy()
            i = np.searchsorted(t[:, 0], key, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(t[i, 1] + key - t[i, 0]), pa.array(t[i, 2])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(spark: SparkSession, docs: DataFrame, path: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset) for docs (doc_id, text).

    A document is its ids and then `end`; null and empty texts are `end` alone. Longer ones than capacity are cut into
    pieces of capacity, the first of which may be shorter. Repeated rows are packed as often as they come; a null
    doc_id stays null; other columns are ignored. Texts are read whole. The sequences made, and how many are needed at
    least, are logged.
    """
    prepare(spark)
    scratch = Scratch(spark, "pack")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, part int"
    pieces = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_slices, _cut(path, capacity, end), schema), "pieces")
    per_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = per_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    filled, least = plan(counts, capacity)
    LOG.info("%d sequences, at least %d are needed", sum(times for _, times in filled), least)
    table = spark.sparkContext.broadcast(_places(filled, capacity))
    ranked = pieces.join(before.select("length", "part", "before"), ["length", "part"]).withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").transform(in_slices, _place(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
