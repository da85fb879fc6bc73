"""Near-duplicate vectors by E8 lattice hashing.

A table rotates the vectors at random, takes BLOCKS_OF coordinates of 8 of the rotated vector, shifts and scales them,
and decodes each block to the nearest point of the E8 lattice (Conway and Sloane, 1982); the points of a table's blocks
and the label are its cell. A vector is filed in its own cell and also probes the neighbouring cells that its blocks
are closest to, so two vectors meet if one's own cell is among the other's. Pairs that meet are verified by cosine in
double precision, each in one cell only: the smallest of those in which it meets, so links can be counted in the cells
and added up without a list of pairs. For components, a cell yields a spanning forest of its links.

Equal vectors of one label are one row with a weight. A cell over REGION vectors is dealt out by pairs of parts, each
pair of vectors in one of them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import Scratch, components, in_slices, prepare
from kelpie.llm.shingles import U, mix

TABLES, BLOCKS_OF, PROBES, SCALE = 6, 2, 2, 4.0
REGION, TILE = 2048, 512


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for k in range(256):
        v = np.where([(k >> i) & 1 for i in range(8)], -0.5, 0.5)
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


ROOTS = _roots()


def _d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    r = np.rint(x)
    odd = (r.sum(1).astype(np.int64) & 1).astype(bool)
    off = x - r
    k = np.abs(off).argmax(1)
    rows = np.flatnonzero(odd)
    step = np.where(off[rows, k[rows]] >= 0, 1.0, -1.0)
    r[rows, k[rows]] += step
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points of rows of 8: the nearer of D8 and D8 + 1/2."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(near[:, None], a, b)


@functools.lru_cache(maxsize=64)
def _table(seed: int, t: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projection, shift and hash keys of a table for vectors of d components."""
    rng, need = np.random.default_rng([seed, t, d]), 8 * BLOCKS_OF
    q = np.linalg.qr(rng.standard_normal((max(d, need), need)))[0][:d]
    return q * (SCALE * np.sqrt(d / 64)), rng.random(need), rng.integers(0, 2**63, (BLOCKS_OF, 8), dtype=U) * U(2) + U(1)


def _cells(v: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the cells of unit vectors: by table, the own cell and then the probed ones."""
    n, d = v.shape
    out = np.empty((n, TABLES, 1 + 2 * BLOCKS_OF * PROBES // 2), U)
    for t in range(TABLES):
        q, shift, keys = _table(seed, t, d)
        y = v @ q + shift
        hs, alts = [], []
        for b in range(BLOCKS_OF):
            x = y[:, 8 * b : 8 * b + 8]
            p = decode(x)
            near = np.argsort(-((x - p) @ ROOTS.T), axis=1, kind="stable")[:, :PROBES]
            code = lambda z, k=keys[b]: mix(((2 * z).astype(np.int64).view(U) * k).sum(-1, dtype=U))
            hs.append(code(p))
            alts.append([code(p + ROOTS[near[:, j]]) for j in range(PROBES)])
        whole = lambda parts, t=t: mix(sum((h * U(2 * i + 3) for i, h in enumerate(parts)), U(0)) + U(t))
        out[:, t, 0] = whole(hs)
        c = 1
        for b in range(BLOCKS_OF):
            for j in range(PROBES):
                out[:, t, c] = whole([alts[i][j] if i == b else hs[i] for i in range(BLOCKS_OF)])
                c += 1
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, emb) to (vec_id, label, dim, vec): unit vectors in double precision, null where there is none."""
    for batch in batches:
        out, dims = [], []
        for label, e in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            x = None
            if label is not None and e.is_valid and e.values is not None and e.values.null_count == 0 and len(e.values):
                x = e.values.to_numpy(zero_copy_only=False).astype(np.float64)
                top = np.abs(x).max()
                x = None if not np.isfinite(x).all() or top == 0 else x / top
                x = None if x is None else x / np.sqrt(x @ x)
            out.append(None if x is None else (x + 0.0).tobytes())
            dims.append(0 if x is None else len(x))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "label", "dim", "vec"])


def _file(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, dims = (batch.column(i).to_numpy() for i in range(3))
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                v = np.frombuffer(b"".join(batch.column(3)[int(i)].as_py() for i in rows)).reshape(len(rows), d)
                cells = mix(_cells(v, seed) + mix(labels[rows].astype(np.int64).view(U) * U(0x9E3779B97F4A7C15) + U(d))[:, None, None])
                k = cells.shape[1] * cells.shape[2]
                flat = cells.reshape(len(rows), k).view(np.int64)
                home = np.zeros((len(rows), k), bool)
                home[:, :: cells.shape[2]] = True
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(list(flat), pa.list_(pa.int64())), pa.array(list(home), pa.list_(pa.bool_()))], names=["id", "cells", "home"])

    return run


def _meet(homes: np.ndarray, cells: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest cell in which each of the pairs meets."""
    out = np.full(len(i), np.iinfo(np.int64).max)
    for x, y in ((i, j), (j, i)):
        hit = homes[x][:, :, None] == cells[y][:, None, :]
        out = np.minimum(out, np.where(hit, homes[x][:, :, None], np.iinfo(np.int64).max).min((1, 2)))
    return out


def _links(least: float):
    """Rows (region, cell, side, id, weight, dim, vec, cells) sorted by region to rows (id, n, other): links counted, and forest edges.

    side: 0 in a whole cell; in a region of two parts 1 and 2, whose pairs are between the parts.
    """

    def region(cell, side, ids, w, v, cells, homes) -> tuple[list, list, list]:
        n = len(ids)
        count, root, edges = np.zeros(n, np.int64), np.arange(n), []
        own = (homes == cell[:, None]).any(1)

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = int(root[x])
            return x

        for a in range(0, n, TILE):
            for b in range(a, n, TILE):
                c = v[a : a + TILE] @ v[b : b + TILE].T >= least
                if a == b:
                    c = np.triu(c, 1)
                c &= own[a : a + TILE, None] | own[None, b : b + TILE]
                c &= (side[a : a + TILE, None] == 0) | (side[a : a + TILE, None] != side[None, b : b + TILE])
                i, j = np.nonzero(c)
                i, j = i + a, j + b
                for s in range(0, len(i), 20_000):
                    x, y = i[s : s + 20_000], j[s : s + 20_000]
                    ok = _meet(homes, cells, x, y) == cell[0]
                    x, y = x[ok], y[ok]
                    np.add.at(count, x, w[y])
                    np.add.at(count, y, w[x])
                    # joins are read off in bulk: only pairs whose roots still differ are walked
                    while len(x):
                        flat = root[root]
                        while (flat != root).any():
                            root[:] = flat
                            flat = root[root]
                        open_ = root[x] != root[y]
                        x, y = x[open_], y[open_]
                        if not len(x):
                            break
                        hi, lo = np.maximum(root[x], root[y]), np.minimum(root[x], root[y])
                        at = np.unique(hi, return_index=True)[1]
                        root[hi[at]] = lo[at]
                        edges.extend(zip(ids[x[at]].tolist(), ids[y[at]].tolist(), strict=True))
        hit = np.flatnonzero(count)
        return ids[hit].tolist() + [e[0] for e in edges], count[hit].tolist() + [None] * len(edges), [None] * len(hit) + [e[1] for e in edges]

    def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        r = rows.column("region").to_numpy()
        at = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        ids, ns, others = [], [], []
        for a, m in zip(at.tolist(), np.diff(np.r_[at, len(r)]).tolist(), strict=True):
            if m < 2:
                continue
            part = rows.slice(a, m)
            d = part.column("dim")[0].as_py()
            v = np.frombuffer(b"".join(part.column("vec").to_pylist())).reshape(m, d)
            cells = np.stack(part.column("cells").to_numpy())
            k = cells.shape[1] // TABLES
            x = region(*(part.column(c).to_numpy() for c in ("cell", "side", "id", "weight")), v, cells, cells[:, ::k])
            for have, new in zip((ids, ns, others), x, strict=True):
                have += new
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(others, pa.int64())], names=["id", "n", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            rest = now if rest is None else pa.concat_tables([rest, now])
            r = rest.column("region").to_numpy()
            cut = int((r == r[-1]).argmax())
            if cut:
                yield from flush(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None:
            yield from flush(rest)

    return run


def near_duplicates(spark: SparkSession, vectors: DataFrame, least: float = 0.98, seed: int = 8) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of vectors (vec_id, embedding, label).

    Vectors are compared within a label only. A null label, a null, empty or zero vector and one with null or
    non-finite components link with nothing; so do vectors of different lengths and rows without a vec_id, whose
    component is null. Rows that repeat a vec_id count as vectors of their own, each linked by its own vector. Other
    columns are ignored.
    """
    prepare(spark)
    scratch = Scratch(spark, "lattice")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    base = scratch.save(base.transform(in_slices, _read, "vec_id long, label long, dim int, vec binary"), "base").withColumn("digest", F.when(F.col("vec_id").isNotNull(), F.md5("vec")))
    same = base.where("digest is not null").groupBy("label", "digest", "dim").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.min("vec").alias("vec"))
    # an id of its own, as a vec_id may have several vectors
    same = scratch.save(same.withColumn("id", F.monotonically_increasing_id()), "same")
    filed = scratch.save(same.select("id", "label", "dim", "vec").transform(in_slices, _file(seed), "id long, cells array<long>, home array<boolean>"), "filed")
    at = filed.select("id", F.explode(F.arrays_zip("cells", "home")).alias("x")).select("id", F.col("x.cells").alias("cell"), F.col("x.home").alias("home")).groupBy("cell", "id").agg(F.max("home").alias("home"))
    met = at.groupBy("cell").agg(F.count("*").alias("m"), F.count_if("home").alias("h")).where("m > 1 and h > 0")
    members = at.join(met, "cell").join(same.select("id", "weight", "dim", "vec"), "id").join(filed.select("id", "cells"), "id")
    parts = F.ceil(F.col("m") / F.lit(REGION)).cast("int")
    members = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    ks = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    members = members.withColumn("k", F.explode(ks))
    members = members.select(F.when(F.col("parts") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("k", "part"), F.greatest("k", "part"))).alias("region"), "cell", F.when((F.col("parts") == 1) | (F.col("k") == F.col("part")), 0).when(F.col("part") < F.col("k"), 1).otherwise(2).alias("side"), "id", "weight", "dim", "vec", "cells")
    found = scratch.save(members.repartition("region").sortWithinPartitions("region", "id").transform(in_slices, _links(least), "id long, n long, other long"), "found")
    comps = components(scratch, found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.where("n is not null").groupBy("id").agg(F.sum("n").alias("n"))
    linked = comps.join(same.select("id", "first"), "id")
    linked = linked.join(linked.groupBy("component_id").agg(F.min("first").alias("least")), "component_id").select("id", "least")
    named = same.select("label", "digest", "dim", "id", "first", "weight").join(counts, "id", "left").join(linked, "id", "left")
    named = scratch.save(named.select("label", "digest", "dim", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id")), "named")
    out = base.join(named, ["label", "digest", "dim"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
