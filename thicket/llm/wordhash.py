"""Words of texts as exact codes and 64-bit hashes, and hashes of word windows.

A word is a run of bytes other than space and 0x09-0x0D. The words of a chunk are numbered, so equal codes mean equal words; the hash of a word is its
XXH3. Windows of words are hashed by a chain of multiplications and shifts. Hashes nominate; what decides is compared by codes, by words or by a
digest of the bytes, as each operator says.

A task holds the words of one chunk, at least one whole text: about 100 bytes of memory a word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

from .common import texts, trim

#: Bytes of text that are handled together.
CHUNK = 4 << 20
U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def coded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word, by first sight, and its hash."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    hashes = np.fromiter(map(xxh3_64_intdigest, known), U, len(known))
    known.default_factory = None
    return codes, hashes[codes]


def hashed(words: list[bytes]) -> np.ndarray:
    """The hash of each word."""
    return np.fromiter(map(xxh3_64_intdigest, words), U, len(words))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of the window that starts at each word; the last size - 1 words start none."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, dtype=U)
    out = h[:n].copy()
    for i in range(1, size):
        out ^= out >> U(32)
        out *= U(0x9E3779B97F4A7C15)
        out += h[i : i + n]
    return mix(out)


def numbered(key: np.ndarray) -> np.ndarray:
    """Equal keys get equal numbers, from 0 on."""
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


class Chunk:
    """Some documents: ids (null: -1 in ids, False in known), raw texts, and their words; document k has words lo[k] to hi[k]. Without numbers, words have hashes alone."""

    def __init__(self, ids: list[int | None], raw: list[bytes], lower: bool = False, numbers: bool = True):
        self.raw, self.known = raw, np.array([x is not None for x in ids], dtype=bool)
        self.ids = np.array([-1 if x is None else x for x in ids], dtype=np.int64)
        parts = [(x.lower() if lower else x).split() for x in raw]  # of bytes: A-Z alone are lower-cased, and spaces are those above
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        words = list(chain.from_iterable(parts))
        self.code, self.hash = coded(words) if numbers else (None, hashed(words))
        self.hi = np.cumsum(size)
        self.lo = self.hi - size
        self.doc = np.repeat(np.arange(len(raw)), size)

    def inside(self, size: int) -> np.ndarray:
        """For each word, whether a window of this size that starts there ends in the same document."""
        left = np.repeat(self.hi, self.hi - self.lo) - np.arange(len(self.doc))
        return left >= size

    def same(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """Whether the windows of this size that start at a and at b hold the same words."""
        out = np.ones(len(a), dtype=bool)
        for i in range(size):
            out &= self.code[a + i] == self.code[b + i]
        return out


def chunks(it: Iterator[pa.RecordBatch], lower: bool = False, numbers: bool = True) -> Iterator[Chunk]:
    """Chunks of the batches' documents. What a chunk took is given back before the next."""
    ids: list[int | None] = []
    raw: list[bytes] = []
    held = 0
    for batch in it:
        for i, t in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            if raw and held + len(t) > CHUNK:
                yield Chunk(ids, raw, lower, numbers)
                ids, raw, held = [], [], 0
                trim()
            ids.append(i)
            raw.append(t)
            held += len(t)
    if raw:
        yield Chunk(ids, raw, lower, numbers)
    del ids, raw
    trim()
