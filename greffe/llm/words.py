"""Words and word windows of Arrow text columns as 64-bit hashes, computed on whole batches with numpy.

A word is a maximal run of bytes other than space and 0x09 to 0x0D. Hashes are functions of the bytes alone, equal on
every machine and in every run.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of a word up to which it is hashed along with all others.
SHORT = 32
_STEP, _ODD = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


#: Masks that keep the first so many bytes of eight.
_FIRST_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and the offset of each; null is as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    every = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    starts: np.ndarray  # of each word, in bytes
    ends: np.ndarray
    docs: np.ndarray  # words of text i: docs[i] to docs[i + 1]

    def __len__(self) -> int:
        return len(self.starts)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.docs) - 1), np.diff(self.docs))


def split(texts: pa.Array, lower: bool = False, gaps: np.ndarray = SEPARATOR) -> Words:
    """gaps: which bytes part words."""
    data, offsets = flat(texts)
    if lower:
        data = LOWER[data]
    gap = gaps[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(len(data), dtype=bool)
    after = np.empty(len(data), dtype=bool)
    if len(data):
        before[0] = after[-1] = True
        before[1:], after[:-1] = gap[:-1], gap[1:]
    starts = np.flatnonzero(~gap & (before | first[:-1]))
    ends = np.flatnonzero(~gap & (after | first[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def hashes(words: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; hashes with different seeds are independent of each other.

    Words of up to SHORT bytes are taken eight bytes at a time, all words of the batch at once. Longer ones, of which
    there are few, are digested one by one.
    """
    data = np.concatenate([words.data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    starts, sizes = words.starts, words.ends - words.starts
    key = mix(np.array([2 * seed + 1, 2 * seed + 2], dtype=np.uint64) * _STEP)
    out = mix(sizes.astype(np.uint64) * _STEP ^ key[0])
    own, at = np.arange(len(words)), 0
    while len(own):
        chunk = eights[starts[own] + at] & _FIRST_BYTES[np.minimum(sizes[own] - at, 8)]
        out[own] = mix((out[own] ^ chunk) * _ODD + key[1])
        at += 8
        own = own[(sizes[own] > at) & (sizes[own] <= SHORT)]
    for i in np.flatnonzero(sizes > SHORT).tolist():
        digest = hashlib.blake2b(words.data[starts[i] : words.ends[i]], digest_size=8, key=seed.to_bytes(8, "little"))
        out[i] = np.frombuffer(digest.digest(), "<u8")[0]
    return out


def windows(word: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of every n consecutive words, also across texts: see inside()."""
    if len(word) < n:
        return np.zeros(0, dtype=np.uint64)
    base = mix(np.array([2 * seed + 1], dtype=np.uint64))[0] | U(1)
    many = len(word) - n + 1
    out = word[:many].copy()
    for j in range(1, n):
        out *= base
        out += word[j : j + many]
    return mix(out ^ base)


def inside(docs: np.ndarray, n: int) -> np.ndarray:
    """Where windows of n words start that lie in one text."""
    counts = np.maximum(np.diff(docs) - n + 1, 0)
    if not counts.sum():
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(counts) - counts
    return np.repeat(docs[:-1] - before, counts) + np.arange(counts.sum())


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    out = x[: len(x) - n + 1].copy()
    for j in range(1, n):
        np.minimum(out, x[j : j + len(out)], out=out)
    return out
