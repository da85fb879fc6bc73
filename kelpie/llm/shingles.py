"""Word and shingle hashes of whole Arrow batches, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

U = np.uint64
BLOCK = 1 << 20
_K = np.random.default_rng(20240607).integers(0, 2**63, 16, dtype=U) * U(2) + U(1)
#: A-Z count as a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
#: Bytes of words: all but white space; and ASCII letters, digits and all beyond ASCII.
SOLID, TERM = np.ones(256, bool), np.zeros(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True
#: Bytes of a word that is its own hash, before it is mixed; the hash of another word has this bit.
SHORT, MANY, LONG_WORD = 7, 64, 1 << 63
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
SEED = 20240607


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def spans(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of data[offsets[0]:offsets[-1]] begin and end, from its first byte, and where each text's words begin (one entry more than texts)."""
    part, at = data[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0]
    n = len(part)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = solid[part]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = at[(at > 0) & (at < n)]
    first[cut] |= word[cut]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[cut - 1] |= word[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def _digests(buffer: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of words in buffer, which has 8 bytes more than text: two lanes that each take up eight bytes at a time; XXH3 for words over MANY bytes."""
    out = np.empty(len(starts), U)
    long = np.flatnonzero(size > MANY)
    if len(long):
        out[long] = np.array([xxh3_64_intdigest(buffer[a : a + n].tobytes(), SEED) for a, n in zip(starts[long].tolist(), size[long].tolist(), strict=True)], U)
    at = np.flatnonzero(size <= MANY)
    eight = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    a = size.astype(U) * _K[10]
    b = a ^ _K[11]
    for k in range(0, int(size[at].max(initial=0)), 8):
        at = at[size[at] > k]
        v = eight[starts[at] + k] & _MASK[np.minimum(size[at] - k, 8)]
        a[at], b[at] = mix(a[at] ^ v) + _K[12], mix(b[at] + v * _K[13]) ^ _K[14]
    short = size <= MANY
    out[short] = mix(a[short] + mix(b[short]))
    return out | U(LONG_WORD)


def word_hashes(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray = SOLID) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word in data[offsets[0]:offsets[-1]], and where each text's words begin (one entry more than texts).

    Words of up to SHORT bytes without a zero byte have hashes of their own; of others 63 bits of a hash of all their bytes are mixed.
    """
    starts, ends, at = spans(data, offsets, solid)
    base, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    if not len(starts):
        return np.zeros(0, U), at
    buffer = np.zeros(n + 8, np.uint8)
    buffer[:n] = _LOWER[data[base : base + n]]
    size = ends - starts
    h = np.ndarray((n + 1,), "<u8", buffer, strides=(1,))[starts] & _MASK[np.minimum(size, SHORT)]
    other = size > SHORT
    if (data[base : base + n] == 0).any():
        zeros = np.cumsum(buffer[:n] == 0)
        other |= zeros[ends - 1] - zeros[starts] + (buffer[starts] == 0) > 0
    other = np.flatnonzero(other)
    if len(other):
        h[other] = _digests(buffer, starts[other], size[other])
    return mix(h), at


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes each; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def shingle_sets(texts: pa.Array, width: int = 3) -> Iterator[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes; fewer words make one shingle, no words none."""
    data, offsets = text_buffers(texts)
    for i, j in blocks(offsets):
        h, at = word_hashes(data, offsets[i : j + 1])
        s = np.zeros(max(len(h) - width + 1, 0), U)
        for k in range(width):
            s += h[k : k + len(s)] * _K[k + 1]
        s = mix(s)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(s[a : b - width + 1])
            elif b > a:
                yield mix((h[a:b] * _K[8 : 8 + b - a]).sum(dtype=U, keepdims=True) + U(b - a))
            else:
                yield np.zeros(0, U)
