"""Exact Jaccard join of word-shingle sets as a metric-space join with pivots, regions and windows.

Jaccard distance is a metric, and so is the size of the symmetric difference. Pivots that are documents are no use at
the top level: nearly all texts lie at distance 1 from them, and a window of twice the threshold would copy every
text to every region. So the regions are made in two levels:

1. The pivots are single shingles with weights that grow with their frequency. A set's region is its lightest shingle
   (an additively weighted Voronoi diagram), and its window are all regions that a set within the threshold can have
   as its own: as such a set lacks at most floor(n / 10) of its n shingles (at 0.9), those are its floor(n / 10) + 1
   lightest shingles. Two linked sets meet in a region, whatever the weights are; rare-first weights keep regions small.
2. In a region a set is a count vector of 256 hash bins. L1 distance of these is a metric that never exceeds the
   symmetric difference. Regions over LEAF sets are split by pivots taken from the sets themselves; a set within
   twice the threshold of another pivot's border, by the triangle inequality, is copied there; recursively.

As components are asked for, a leaf yields a spanning forest of the pairs within the L1 bound, not all of them. The
forests of all regions fall into families, each set in one: two linked sets are in the same. A spanning forest of each
family is verified on the whole sets, which meet in one task where it can hold them; where all of it holds, the family
is a component. Where a pair fails, a forest of verified links is grown between the components it has so far; so no link
between different components is lost, and none that isn't verified is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import FEW, Scratch, components, in_slices, prepare
from kelpie.llm.shingles import U, mix, shingle_sets

#: Hash bins of a set's counts in regions, and of whole sets; by their bits.
BIN_BITS, WIDE_BITS = 8, 10
BINS = 1 << BIN_BITS
#: Frequencies are counted in so many hash buckets, a fixed size: they only order the pivots, any order is exact.
BUCKETS = 1 << 20
CHUNK = 1 << 14
#: Sets in a region that isn't split by pivots; sets in a region that one task gets; shingles of whole sets that it gets, about.
LEAF, REGION, WHOLE = 512, 8192, 1 << 23
SEEN = 1 << 20
SECOND = 0x2545F4914F6CDD1D
FILTER_BITS, CELL_BITS = 1 << 23, 1 << 26
#: Cells that a task packs at once.
PRINTS = 1 << 20


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _class(s: np.ndarray, key: int = 0x5851F42D4C957F2D) -> int:
    """A 64-bit digest of a set. Sets are the same where two digests by different keys and their sizes are."""
    with np.errstate(over="ignore"):
        return int((mix(s ^ U(key)).sum(dtype=U) ^ (U(len(s)) * U(0x14057B7EF767814F))).astype(np.int64))


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            n, cls, cls2, sketch, seen = [], [], [], [], []
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                cls.append(_class(s))
                cls2.append(_class(s, SECOND))
                sketch.append(np.minimum(np.bincount((s >> U(64 - BIN_BITS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes())
                seen.append(s)
            if seen:
                total += np.bincount(((np.concatenate(seen) >> U(20)) & U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
            k = len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(cls2, pa.int64()), pa.array(sketch, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=["doc_id", "n", "cls", "cls2", "sketch", "chunk", "counts"])
        k = BUCKETS // CHUNK
        counts = np.minimum(total, 2**31 - 1).astype(np.int32).reshape(k, CHUNK)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(k, pa.int64()) for _ in range(4)), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array([x.tobytes() for x in counts], pa.binary())], names=["doc_id", "n", "cls", "cls2", "sketch", "chunk", "counts"])

    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of counts, added up within a task."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(b.as_buffer(), np.int32).astype(np.int64)
            total[c] = total[c] + x if c in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in total.values()], pa.binary())], names=["chunk", "counts"])


def frequencies(described: DataFrame) -> np.ndarray:
    """Shingles of all texts in each hash bucket: a fixed 4 MB, whatever the input."""
    rows = described.where("chunk is not null").select("chunk", "counts").repartition(16, "chunk").transform(in_slices, _add_counts, "chunk int, counts binary")
    out = np.zeros(BUCKETS, np.int32)
    for r in rows.collect():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, np.int32)
    return out


def _set_windows(texts: pa.Array, width: int, low: int, weight: np.ndarray, done: set) -> Iterator[tuple[int, np.ndarray]]:
    """Digest and window of each set that isn't done. low: the threshold in hundredths."""
    for s in shingle_sets(texts, width):
        n = len(s)
        keep = n - -(-low * n // 100) + 1
        if not n or (n + 1) * low > 100 * n:  # no other set is within the threshold
            continue
        c = _class(s)
        if c in done:
            continue
        if len(done) >= SEEN:
            done.clear()
        done.add(c)
        # s is sorted, so ties go by the whole hash
        yield c, s[np.argsort(weight[((s >> U(20)) & U(BUCKETS - 1)).astype(np.int64)], kind="stable")[:keep]] if keep < n else s


def _prints(width: int, low: int, weights, bits: int):
    """Texts to rows (part, prints): the cells of all windows by their first bits, each as its next 32 bits."""

    def packed(cells: list[np.ndarray]) -> pa.RecordBatch:
        codes = np.sort(np.concatenate(cells) >> U(32 - bits))
        parts, at = np.unique(codes >> U(32), return_index=True)
        prints = codes.astype(np.uint32)
        return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array([x.tobytes() for x in np.split(prints, at[1:])], pa.binary())], names=["part", "prints"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, done, cells, n = weights.value, set(), [], 0
        for batch in batches:
            for _, s in _set_windows(batch.column(0), width, low, weight, done):
                cells.append(s)
                n += len(s)
                if n >= PRINTS:
                    yield packed(cells)
                    cells, n = [], 0
        if cells:
            yield packed(cells)

    return run


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _prints, sorted by part, to the codes (part and print) that come more than once."""
    part, own = None, []

    def flush() -> pa.RecordBatch:
        x = np.sort(np.concatenate(own))
        again = np.unique(x[1:][x[1:] == x[:-1]]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(again | (part << 32))], names=["code"])

    for batch in batches:
        for p, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if p != part and own:
                yield flush()
                own = []
            part = p
            own.append(np.frombuffer(x.as_buffer(), np.uint32))
    if own:
        yield flush()


def _windows(width: int, low: int, weights, bits: int, wanted):
    """Texts to rows (cell, cls) of those cells whose code passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, done, on = weights.value, set(), np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            cells, owners, sizes = [], [], []
            for c, s in _set_windows(batch.column(0), width, low, weight, done):
                at = (mix(s >> U(32 - bits)) & U(CELL_BITS - 1)).astype(np.int64)
                s = s[(on[at >> 3] >> (at & 7) & 1).astype(bool)]
                cells.append(s)
                owners.append(c)
                sizes.append(len(s))
            if cells:
                yield pa.RecordBatch.from_arrays([_long(np.concatenate(cells)), pa.array(np.repeat(np.array(owners, np.int64), sizes))], names=["cell", "cls"])

    return run


def _filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes to rows (k, bits): the parts that aren't empty of a filter of CELL_BITS."""
    on = np.zeros(CELL_BITS // 8, np.uint8)
    for batch in batches:
        at = (mix(batch.column(0).to_numpy().view(U)) & U(CELL_BITS - 1)).astype(np.int64)
        np.bitwise_or.at(on, at >> 3, (1 << (at & 7)).astype(np.uint8))
    parts = on.reshape(-1, 4096)
    k = np.flatnonzero(parts.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array([parts[i].tobytes() for i in k], pa.binary())], names=["k", "bits"])


def shared_cells(scratch: Scratch, texts: DataFrame, own: DataFrame, width: int, low: int, weights) -> tuple[int, bytes]:
    """A filter of a fixed size of cells that come more than once, and the bits of a cell's code beyond 32.

    Only four bytes of each cell are shuffled, by its first bits, for most cells have one set. Two cells of one code pass
    both, as do those of a set that several tasks have; either costs rows, not links.
    """
    n = own.select(F.sum(F.expr(f"n - ceil({low} * n / 100) + 1"))).first()[0] or 0
    bits = min(20, max(6, (int(n) >> 18).bit_length()))
    prints = texts.transform(in_slices, _prints(width, low, weights, bits), "part int, prints binary")
    codes = scratch.save(prints.repartition("part").sortWithinPartitions("part").transform(in_slices, _twice, "code long"), "codes")
    out = bytearray(CELL_BITS // 8)
    for r in codes.transform(in_slices, _filter, "k long, bits binary").groupBy("k").agg(F.expr("collect_set(bits)").alias("bits")).toLocalIterator():
        whole = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in r.bits])
        out[r.k * 4096 : (r.k + 1) * 4096] = whole.tobytes()
    scratch.drop("codes")
    return bits, bytes(out)


def _near(n: np.ndarray, sk: np.ndarray, i: int, js: np.ndarray, low: int) -> np.ndarray:
    """Which of js can be within the threshold of i: by size, and by L1 distance of the bins, which the symmetric difference isn't under."""
    a, b = n[i], n[js]
    d = np.abs(sk[js] - sk[i]).sum(1, dtype=np.int64)
    return (100 * np.minimum(a, b) >= low * np.maximum(a, b)) & ((100 + low) * d <= (100 - low) * (a + b))


def _leaf(n: np.ndarray, sk: np.ndarray, own: np.ndarray, low: int) -> list[tuple[int, int]]:
    """A spanning forest, breadth first: each set reached claims all sets near it that aren't reached yet."""
    todo, edges = own, []
    while len(todo) > 1:
        queue, todo = [int(todo[0])], todo[1:]
        while queue and len(todo):
            u = queue.pop()
            hit = _near(n, sk, u, todo, low)
            edges += [(u, v) for v in todo[hit].tolist()]
            queue += todo[hit].tolist()
            todo = todo[~hit]
    return edges


def _split(n: np.ndarray, sk: np.ndarray, own: np.ndarray, low: int) -> list[tuple[int, int]]:
    """The forest of a region: Voronoi regions of 16 far-apart pivots, with windows, until they are small or no longer shrink."""
    if len(own) <= LEAF:
        return _leaf(n, sk, own, low)
    pivots, far = [int(own[0])], None
    dist = []
    while len(pivots) <= 16:
        d = np.abs(sk[own] - sk[pivots[-1]]).sum(1, dtype=np.int64)
        dist.append(d)
        far = d if far is None else np.minimum(far, d)
        pivots.append(int(own[int(far.argmax())]))
    D = np.stack(dist, 1)
    home = D.min(1)
    reach = n[own] * (100 - low) // low + 1  # the largest symmetric difference within the threshold: (100-low)/(100+low) * (n + n*100/low)
    inside = D <= (home + 2 * reach)[:, None]
    if inside.sum(0).max() > 0.7 * len(own) or inside.sum() > 4 * len(own):
        return _leaf(n, sk, own, low)
    return [e for k in range(inside.shape[1]) for e in _split(n, sk, own[inside[:, k]], low)]


def _regions(low: int):
    """Rows (region, id, n, sketch), sorted by region, to pairs (a, b)."""

    def flush(r, ids, n, sk) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        aa, bb = [], []
        for s, m in zip(at.tolist(), np.diff(np.r_[at, len(r)]).tolist(), strict=True):
            own = np.arange(s, s + m)
            own = own[np.unique(ids[own], return_index=True)[1]]
            edges = _split(n, sk, own, low)
            if edges:
                e = np.array(edges)
                aa.append(ids[e[:, 0]])
                bb.append(ids[e[:, 1]])
        if aa:
            yield _ordered(np.concatenate(aa), np.concatenate(bb))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)), _sketches(batch.column(3))]
            rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            cut = int((rest[0] == rest[0][-1]).argmax())
            if cut:
                yield from flush(*[x[:cut] for x in rest])
                rest = [x[cut:] for x in rest]
        if rest is not None:
            yield from flush(*rest)

    return run


def _sketches(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16)


def _ordered(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _couples(low: int):
    """Rows (a, n, sketch, b, n, sketch), for regions of two sets, to pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, n, b, m = (batch.column(i).to_numpy() for i in (0, 1, 3, 4))
                d = np.abs(_sketches(batch.column(2)) - _sketches(batch.column(5))).sum(1, dtype=np.int64)
                ok = (a != b) & (100 * np.minimum(n, m) >= low * np.maximum(n, m)) & ((100 + low) * d <= (100 - low) * (n + m))
                yield _ordered(a[ok], b[ok])

    return run


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Elements of both of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def _grown(ids: list, label: np.ndarray, sets: list[np.ndarray], low: int) -> list[tuple[int, int]]:
    """Verified links that join all components, given by label, that links join."""
    n = np.array([len(s) for s in sets])
    sk = np.stack([np.minimum(np.bincount((s.view(U) >> U(64 - WIDE_BITS)).astype(np.int64), minlength=1 << WIDE_BITS), 255) for s in sets]).astype(np.int16)
    label, links = label.copy(), []
    for i in range(len(sets) - 1):
        js = np.arange(i + 1, len(sets))
        js = js[label[js] != label[i]]
        if not len(js):
            continue
        for j in js[_near(n, sk, i, js, low)].tolist():
            if label[j] != label[i] and _linked(sets[i], sets[j], low):
                links.append((ids[i], ids[j]))
                label[label == label[j]] = label[i]
    return links


def _linked(x: np.ndarray, y: np.ndarray, low: int) -> bool:
    both = _common(x, y)
    return 100 * both >= low * (len(x) + len(y) - both)


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])


def _families(low: int):
    """Rows (region, id, comp, items), sorted by region, to verified links (a, b) that join all components that links join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict = {"region": None}

        def flush() -> list[tuple[int, int]]:
            return _grown(rest["ids"], np.unique(np.array(rest["comps"]), return_inverse=True)[1], rest["sets"], low) if rest["region"] is not None else []

        for batch in batches:
            links = []
            for r, i, c, s in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if r != rest["region"]:
                    links += flush()
                    rest = {"region": r, "ids": [], "comps": [], "sets": []}
                rest["ids"].append(i)
                rest["comps"].append(c)
                rest["sets"].append(s.values.to_numpy())
            yield _pairs(links)
        yield _pairs(flush())

    return run


def _whole(low: int):
    """Rows (family, a, b, items), sorted by family: whole families' sets, each as its id a, and a spanning forest of their pairs (a, b), to verified links that join all that links join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, pairs = None, {}, []

        def flush() -> list[tuple[int, int]]:
            ids = list(sets)
            at = {x: k for k, x in enumerate(ids)}
            label, links = np.arange(len(ids)), []
            for a, b in pairs:
                i, j = at[a], at[b]
                if label[i] != label[j] and _linked(sets[a], sets[b], low):
                    links.append((a, b))
                    label[label == label[j]] = label[i]
            return links + (_grown(ids, label, list(sets.values()), low) if len(np.unique(label)) > 1 else [])

        for batch in batches:
            links = []
            for f, a, b, s in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if f != now:
                    links += flush() if sets else []
                    now, sets, pairs = f, {}, []
                if b is None:
                    sets[a] = s.values.to_numpy()
                else:
                    pairs.append((a, b))
            yield _pairs(links)
        yield _pairs(flush() if sets else [])

    return run


def _spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of edges that make a spanning forest of all."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, at, root, kept = ends[: len(a)], ends[len(a) :], np.arange(len(a)), np.arange(len(ids)), []
    while len(at):
        x, y = root[i], root[j]
        open_ = x != y
        i, j, at, x, y = (z[open_] for z in (i, j, at, x, y))
        high, first = np.unique(np.maximum(x, y), return_index=True)
        root[high] = np.minimum(x, y)[first]  # each root is hung under a smaller one, so no ring closes
        kept.append(at[first])
        while (root[root] != root).any():
            root = root[root]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, a, b), sorted by part, to a spanning forest (a, b) of each part."""
    rest = None

    def flush(part: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        keep = np.concatenate([s + _spanning(a[s:e], b[s:e]) for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    for batch in batches:
        now = [batch.column(i).to_numpy() for i in range(3)]
        rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
        cut = int((rest[0] == rest[0][-1]).argmax())
        if cut:
            yield flush(*(x[:cut] for x in rest))
            rest = [x[cut:] for x in rest]
    if rest is not None:
        yield flush(*rest)


def _sets(width: int, wanted):
    """Rows (doc_id, text, place in the filter) to rows (doc, n, cls, cls2, items) of those that pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(wanted.value, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            hit = bits[batch.column(2).to_numpy()]
            if hit.any():
                part = batch.filter(pa.array(hit))
                rows = [(len(s), _class(s), _class(s, SECOND), np.sort(s.view(np.int64))) for s in shingle_sets(part.column(1), width)]
                n, cls, cls2, sets = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (n, cls, cls2)), pa.array(sets, pa.list_(pa.int64()))], names=["doc", "n", "cls", "cls2", "items"])

    return run


def _bits(rows: DataFrame, at, size: int) -> bytes:
    """A filter of a fixed size (1 MB) with the bits at: for scans that would otherwise shuffle what they read."""
    rows = rows.select((at + 1).alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    out = bytearray(size // 8)
    for r in rows.collect():
        out[(r.k - 1) * 4096 : r.k * 4096] = r.bits
    return bytes(out)


def jaccard_components(spark: SparkSession, docs: DataFrame, width: int = 3, low: int = 90) -> DataFrame:
    """Rows (doc_id, n_shingles, class_id, component_id) for docs with columns doc_id (long) and text.

    low: the least similarity, in hundredths; width: words in a shingle, up to 9. class_id: the smallest doc_id with the
    same set; component_id: the smallest doc_id reachable. Null and empty texts have no shingles and are alone; a row
    whose doc_id is null links with nothing and has null for both. Repeated rows come back as often as they came; rows
    that share a doc_id but not a text are documents of their own, each linked by its own text. Texts are read whole.
    Other columns are ignored. A set is held as 64-bit hashes of its shingles, and known by 128 bits and its size.
    """
    if not 1 <= width <= 9:
        raise ValueError("width must be 1 to 9")
    prepare(spark)
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = "doc_id long, n long, cls long, cls2 long, sketch binary, chunk int, counts binary"
    described = scratch.save(docs.transform(in_slices, _describe(width), kinds), "described")
    weights = spark.sparkContext.broadcast(frequencies(described))
    own = described.where("chunk is null").select("doc_id", "n", "cls", "cls2", "sketch")
    # a set's id is its own, as a doc_id may have several; doc is the smallest doc_id that has the set
    classes = own.where("n > 0 and doc_id is not null").groupBy("cls", "cls2", "n").agg(F.min("doc_id").alias("doc"), F.min("sketch").alias("sketch"))
    classes = scratch.save(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    # A task knows its own sets only: a set with copies in several tasks comes once from each. The sets of a region are
    # made distinct, as an even number of one would cancel in x.
    texts = docs.where("text is not null and doc_id is not null").select("text")
    bits, passing = shared_cells(scratch, texts, own, width, low, weights)
    cells = texts.transform(in_slices, _windows(width, low, weights, bits, spark.sparkContext.broadcast(passing)), "cell long, cls long")
    cells = scratch.save(cells.dropDuplicates(["cell", "cls"]), "members")
    met = cells.groupBy("cell").agg(F.count("*").alias("m"), F.bit_xor("cls").alias("x"), F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("m > 1")
    # regions with the same sets count once; those of two sets are known by their least and greatest
    kept = scratch.save(met.groupBy("m", "x", "lo", "hi").agg(F.min("cell").alias("cell")), "kept")
    one, two = (classes.select(F.col("cls").alias(c), F.col("id").alias(f"i_{c}"), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in ("lo", "hi"))
    couples = kept.where("m = 2").select("lo", "hi").distinct().join(one, "lo").join(two, "hi").select("i_lo", "n_lo", "s_lo", "i_hi", "n_hi", "s_hi").transform(in_slices, _couples(low), "a long, b long")

    many = kept.where("m > 2").select("cell", F.ceil(F.col("m") / F.lit(REGION)).cast("int").alias("parts"))
    members = cells.join(many, "cell").join(classes, "cls")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    # A region too large for one task is dealt out by pairs of parts, each of which gets the sets of both.
    pair = F.when(F.col("parts") == 1, F.array(F.col("cell"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.xxhash64("cell", F.least(k, part), F.greatest(k, part))))
    members = members.select(F.explode(pair).alias("region"), "id", "n", "sketch")
    edges = members.repartition("region").sortWithinPartitions("region", "id").transform(in_slices, _regions(low), "a long, b long")
    pairs = scratch.save(couples.unionByName(edges).distinct(), "pairs")
    scratch.drop("members", "kept")

    # Families that one task can hold are verified there, each set of them shuffled once; others edge by edge.
    family = components(scratch, pairs, "cc-f")
    ids = family.withColumnRenamed("component_id", "family").join(classes.select("id", "doc", "n", "cls", "cls2"), "id")
    size = ids.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / F.lit(REGION)), F.ceil(F.sum("n") / F.lit(WHOLE))).cast("int").alias("parts"))
    size = scratch.save(size, "sizes")
    ids = scratch.save(ids.join(size.select("family", (F.col("parts") > 1).alias("large")), "family"), "ids")
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)).cast("long")
    wanted = spark.sparkContext.broadcast(_bits(ids, at("doc"), FILTER_BITS))
    read = docs.where("doc_id is not null").select("doc_id", "text", at("doc_id").alias("p")).transform(in_slices, _sets(width, wanted), "doc long, n long, cls long, cls2 long, items array<long>")
    own_ids = F.broadcast(ids) if ids.count() <= FEW else ids
    sets = scratch.save(read.join(own_ids, ["doc", "n", "cls", "cls2"]).select("id", "family", "large", "items"), "sets")
    if not sets.groupBy("id").count().where("count > 1").isEmpty():  # rows that come twice
        sets = scratch.save(sets.dropDuplicates(["id"]), "single-sets")
    of = ids.select(F.col("id").alias("a"), "family", "large")
    pairs = pairs.join(of, "a")

    # Of a family's pairs a spanning forest is verified; where all of it holds, the family is a component.
    def forest(of_pairs: DataFrame, tag: str) -> DataFrame:
        count = of_pairs.groupBy("family").agg(F.ceil(F.count("*") / F.lit(FEW)).cast("int").alias("parts"))
        parts = of_pairs.join(count, "family").select(F.xxhash64("family", F.pmod(F.xxhash64("a", "b"), F.col("parts"))).alias("part"), "a", "b")
        return scratch.save(parts.repartition("part").sortWithinPartitions("part").transform(in_slices, _thin, "a long, b long"), tag)

    none = F.lit(None).cast("array<long>")
    small = forest(pairs.where("not large"), "forest").join(of, "a").select("family", "a", "b", none.alias("items"))
    small = small.unionByName(sets.where("not large").select("family", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "items"))
    comps = scratch.save(small.repartition("family").sortWithinPartitions("family").transform(in_slices, _whole(low), "a long, b long"), "links")
    if not size.where("parts > 1").isEmpty():
        large = sets.where("large")
        one, two = large.select(F.col("id").alias("a"), F.col("items").alias("x")), large.select(F.col("id").alias("b"), F.col("items").alias("y"))
        both = F.size(F.array_intersect("x", "y")).cast("long")
        links = forest(pairs.where("large"), "large-forest").join(one, "a").join(two, "b").select("a", "b", (100 * both >= low * (F.size("x") + F.size("y") - both)).alias("linked"))
        links = scratch.save(links, "large-links")
        linked = links.where("linked").select("a", "b")
        failed = scratch.save(links.where("not linked").join(of, "a").select("family").distinct(), "failed")
        so_far = components(scratch, linked, "cc-a")
        rows = ids.select("id", "family").join(failed, "family", "left_semi").join(size, "family").join(so_far, "id", "left").select("family", "parts", "id", F.coalesce("component_id", "id").alias("comp"))
        pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.xxhash64("family", F.least(k, part), F.greatest(k, part)))
        rows = rows.select(F.explode(pair).alias("region"), "id", "comp").join(large.select("id", "items"), "id").select("region", "id", "comp", "items")
        more = rows.repartition("region").sortWithinPartitions("region", "comp", "id").transform(in_slices, _families(low), "a long, b long")
        comps = scratch.save(comps.unionByName(linked).unionByName(more), "all-links")
    comps = components(scratch, comps, "cc-b")
    members = comps.join(classes.select("id", "doc"), "id")
    first = members.groupBy("component_id").agg(F.min("doc").alias("first"))
    firsts = members.join(first, "component_id").select("id", "first")
    named = classes.join(firsts, "id", "left").select("cls", "cls2", "n", F.col("doc").alias("class_id"), F.coalesce("first", "doc").alias("component_id"))
    named = scratch.save(named, "named")
    rows = own.where("n > 0 and doc_id is not null").join(named, ["cls", "cls2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")
    return rows.unionByName(own.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id")))
