"""Media columns: payloads cut by content, chunks kept once, and payloads rebuilt from ordered chunk lists and verified.

A payload is cut where a rolling gear hash over its last 16 bytes has BITS zero bits, so equal passages give equal
chunks wherever they stand. A first pass finds the digests that occur more than once, by a partial aggregation. The
second writes the stored form: a manifest, which is the header and the ordered list of chunk sizes and digests, and the
chunks. Those that are a payload's alone stay beside its manifest; the others go, once per task, to a store in which
Spark's aggregation by digest leaves one copy. A bit filter of fixed size tells the two apart in the scan, so texts are
never shuffled; a false hit only sends a chunk through the store. Both tables are written to the shared folder and read
back: the bytes of a medium are those of its manifest and then of its chunks, in order, as they were read. Payloads
with equal manifests are rebuilt once, by a join with the store, and every chunk's digest is checked.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import Scratch, in_slices, prepare

LEAST, BITS, MOST = 512, 11, 16384
FILTER_BITS = 1 << 24
SEEN = 1 << 18
MAGIC = b"KMC1"
_GEAR = np.random.default_rng(8191).integers(0, 2**16, 256, dtype=np.uint16)
_MASK = np.uint16((2**BITS - 1) << (16 - BITS))


def payload(text: str | None, unit: int) -> tuple[int, bytes]:
    """Its UTF-8 bytes, and those with bytes 255 up to a positive multiple of unit."""
    raw = (text or "").encode()
    size = max(1, -(-len(raw) // unit)) * unit
    return len(raw), raw.ljust(size, b"\xff")


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: LEAST to MOST bytes each, but for a shorter last one."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):  # h[i] = sum of gear[data[i - j]] << j over the last 16 bytes, by doubling
        h[k:] = h[k:] + (h[:-k] << np.uint16(k))
    marks, out, start = np.flatnonzero((h & _MASK) == 0) + 1, [], 0
    i = 0
    while len(data) - start > LEAST:
        i = int(np.searchsorted(marks, start + LEAST))
        end = min(int(marks[i]) if i < len(marks) else len(data), start + MOST, len(data))
        out.append(end)
        start = end
    return out if start == len(data) else [*out, len(data)]


def chunks(data: bytes) -> list[bytes]:
    start, out = 0, []
    for end in cuts(data):
        out.append(data[start:end])
        start = end
    return out


def digest(chunk: bytes) -> tuple[int, int]:
    x = hashlib.blake2b(chunk, digest_size=16).digest()
    return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)


def manifest(n_bytes: int, parts: list[bytes], keys: list[tuple[int, int]]) -> bytes:
    """What stands before the chunks of a medium: MAGIC, the unpadded size, the number of chunks, and their sizes and digests."""
    head = MAGIC + n_bytes.to_bytes(8, "little") + len(parts).to_bytes(4, "little")
    return b"".join([head, *(len(p).to_bytes(4, "little") + a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True) for p, (a, b) in zip(parts, keys, strict=True))])


def listed(head: bytes) -> tuple[int, list[tuple[int, tuple[int, int]]]]:
    """Unpadded size and chunk list (size, digest) of a manifest, or of a medium that begins with it."""
    if head[:4] != MAGIC:
        raise ValueError("not a media container")
    number = lambda a, n, signed=False: int.from_bytes(head[a : a + n], "little", signed=signed)
    return number(4, 8), [(number(a, 4), (number(a + 4, 8, True), number(a + 12, 8, True))) for a in range(16, 16 + 20 * number(12, 4), 20)]


def joined(chunk_list: list[tuple[int, tuple[int, int]]], parts: list[bytes]) -> bytes:
    """The payload of chunks, each checked against the list."""
    for (size, key), part in zip(chunk_list, parts, strict=True):
        if len(part) != size or digest(part) != key:
            raise ValueError("a chunk does not match its digest")
    return b"".join(parts)


def opened(media: bytes) -> tuple[int, bytes]:
    """Unpadded size and payload of a whole medium."""
    n_bytes, chunk_list = listed(media)
    at, parts = 16 + 20 * len(chunk_list), []
    for size, _ in chunk_list:
        parts.append(media[at : at + size])
        at += size
    return n_bytes, joined(chunk_list, parts)


def feature(data: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the mean step between neighbours."""
    x = np.frombuffer(data, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    v = np.arange(256)
    mean = float(p @ v)
    q = p[p > 0]
    step = float(np.abs(np.diff(x.astype(np.int16))).mean())
    return f"mean={mean:.4f};dev={float(p @ (v - mean) ** 2) ** 0.5:.4f};bits={float(-(q * np.log2(q)).sum()):.4f};step={step:.4f}"


def _digests(unit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [digest(c) for t in batch.column(0).to_pylist() for c in chunks(payload(t, unit)[1])]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], names=["k1", "k2"])

    return run


LISTS = "doc_id long, m1 long, m2 long, manifest binary, shared array<boolean>, own binary, r1 array<long>, r2 array<long>"
STORED = pa.schema([("doc_id", pa.int64()), ("m1", pa.int64()), ("m2", pa.int64()), ("manifest", pa.binary()), ("shared", pa.list_(pa.bool_())), ("own", pa.binary()), ("r1", pa.list_(pa.int64())), ("r2", pa.list_(pa.int64())), ("s1", pa.int64()), ("s2", pa.int64()), ("data", pa.binary())])


def _store(unit: int, repeated):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(repeated.value, np.uint8)
        seen: set = set()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(texts), 256):
                rows: list[tuple] = []
                for doc, t in zip(ids[a : a + 256], texts[a : a + 256], strict=True):
                    n, data = payload(t, unit)
                    parts = chunks(data)
                    keys = [digest(c) for c in parts]
                    head = manifest(n, parts, keys)
                    m = digest(head)
                    if len(seen) > SEEN:
                        seen.clear()
                    if m in seen:
                        rows.append((doc, *m, *(None,) * 8))
                        continue
                    shared = [bool(bits[(p := k[0] & (FILTER_BITS - 1)) >> 3] >> (p & 7) & 1) for k in keys]
                    if any(shared):
                        seen.add(m)
                    refs = [k for k, s in zip(keys, shared, strict=True) if s]
                    rows.append((doc, *m, head, shared, b"".join(c for c, s in zip(parts, shared, strict=True) if not s), [k[0] for k in refs], [k[1] for k in refs], None, None, None))
                    for k, c, s in zip(keys, parts, shared, strict=True):
                        if s and k not in seen:
                            seen.add(k)
                            rows.append((*(None,) * 8, *k, c))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), STORED, strict=True)], schema=STORED)

    return run


RESULT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(keep: list[str]):
    """Rows (*keep, manifest, shared, own, parts) as they were stored to media, read back and described. parts: the shared chunks, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(k) for k in keep]
            out: list[list] = [[] for _ in range(7)]
            for i in range(batch.num_rows):
                head, shared, own, more = (batch.column(c)[i].as_py() for c in ("manifest", "shared", "own", "parts"))
                n_bytes, chunk_list = listed(head)
                at, more, parts = 0, iter(more or ()), []
                for (size, _), s in zip(chunk_list, shared, strict=True):
                    parts.append(next(more) if s else own[at : at + size])
                    at += 0 if s else size
                data = joined(chunk_list, parts)
                sha = hashlib.sha256(head)
                sha.update(data)
                for c, v in zip(out, (n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(head) + len(data), sha.hexdigest(), feature(data)), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split()[0] for x in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=[*keep, *names])

    return run


def _bits(keys: DataFrame) -> bytes:
    at = F.col("k1").bitwiseAND(FILTER_BITS - 1) + 1
    rows = keys.select(at.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for r in rows.collect():
        out[(r.k - 1) * 4096 : r.k * 4096] = r.bits
    return bytes(out)


def store(spark: SparkSession, docs: DataFrame, unit: int = 576) -> tuple[DataFrame, DataFrame]:
    """Writes docs (doc_id, text) as media: the table of chunk lists, and the store with one row for each shared chunk."""
    prepare(spark)
    scratch = Scratch(spark, "media")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = docs.select("text").transform(in_slices, _digests(unit), "k1 long, k2 long")
    repeated = spark.sparkContext.broadcast(_bits(keys.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1")))
    written = scratch.save(docs.transform(in_slices, _store(unit, repeated), f"{LISTS}, s1 long, s2 long, data binary"), "written")
    lists = written.where("m1 is not null").drop("s1", "s2", "data")
    kept = scratch.save(written.where("s1 is not null").select("s1", "s2", "data").dropDuplicates(["s1", "s2"]), "chunks")
    return lists, kept


def describe(lists: DataFrame, kept: DataFrame) -> DataFrame:
    """Reads the media back; rows (doc_id, RESULT)."""
    whole, some = "manifest is not null and not exists(shared, x -> x)", "manifest is not null and exists(shared, x -> x)"
    columns = ["manifest", "shared", "own", "parts"]
    alone = lists.where(whole).withColumn("parts", F.lit(None).cast("array<binary>")).select("doc_id", *columns)
    first = alone.transform(in_slices, _read(["doc_id"]), f"doc_id long, {RESULT}")
    once = lists.where(some).drop("doc_id").dropDuplicates(["m1", "m2"])
    refs = once.select("m1", "m2", F.posexplode(F.arrays_zip("r1", "r2")).alias("p", "x")).select("m1", "m2", "p", F.col("x.r1").alias("s1"), F.col("x.r2").alias("s2"))
    parts = refs.join(kept, ["s1", "s2"]).groupBy("m1", "m2").agg(F.sort_array(F.collect_list(F.struct("p", "data"))).alias("x")).select("m1", "m2", F.col("x.data").alias("parts"))
    read = once.join(parts, ["m1", "m2"]).select("m1", "m2", *columns).transform(in_slices, _read(["m1", "m2"]), f"m1 long, m2 long, {RESULT}")
    rest = lists.where(f"manifest is null or {some}").select("doc_id", "m1", "m2")
    return first.unionByName(rest.join(read, ["m1", "m2"]).drop("m1", "m2"))


def media_columns(spark: SparkSession, docs: DataFrame, unit: int = 576) -> DataFrame:
    """Rows (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature).

    Null and empty texts are one unit of padding. Repeated rows are repeated, a null doc_id stays null, other columns
    are ignored. Equal texts give equal values. A medium is stored as a manifest and chunks; media_bytes and media_sha256
    are of these, as read back.
    """
    return describe(*store(spark, docs, unit))
