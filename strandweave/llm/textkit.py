"""Vectorised word scanning and shingling over Arrow string columns (runs in executors' Python).

Words are maximal runs of bytes outside ``0x20`` and ``0x09-0x0D``; those are ASCII, so
scanning UTF-8 bytes finds the same words as scanning code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once; a longer document is handled alone.
CHUNK_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Fixed multiples of it, one for each place in a window.
_PLACE = np.arange(1, 65, dtype=np.uint64) * _ODD


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTE_FOLDED = _BYTE[_FOLD]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0xD6E8FEB86659FD93
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSE = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        _POWERS = np.full(size, _BASE, dtype=np.uint64)
        _INVERSE = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        _POWERS[0] = _INVERSE[0] = 1
        np.multiply.accumulate(_POWERS, out=_POWERS)
        np.multiply.accumulate(_INVERSE, out=_INVERSE)
    return _POWERS[:n], _INVERSE[:n]


@dataclass
class Words:
    """Words of consecutive texts: byte bounds, a hash each, and each text's word range."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # len(texts) + 1: words of text i are first[i]:first[i + 1]
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def as_string_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    return column.cast(pa.large_string())


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and len + 1 offsets into them; a null counts as empty."""
    texts = as_string_array(texts).fill_null("")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def scan_words(texts: pa.Array, fold_case: bool = False) -> Words:
    """Words of all texts. Bytes are hashed in pieces that end at white space or between texts, so a very

    long text needs some 24 bytes a word, and the tables of powers stay at the size of a piece (a word that
    is longer than a piece is one).
    """
    raw, offsets = raw_bytes(texts)
    inside = ~_SPACE[raw]
    parts, at = [], 0
    while at < len(raw):
        to = min(len(raw), at + CHUNK_BYTES)
        while to < len(raw) and inside[to]:
            gap = np.flatnonzero(~inside[to : to + CHUNK_BYTES])
            to = to + int(gap[0]) if len(gap) else min(len(raw), to + CHUNK_BYTES)
        parts.append(_words(raw, inside, offsets, at, to, fold_case))
        at = to
    starts, ends, hashes = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return Words(raw, starts, ends, hashes, np.searchsorted(starts, offsets), offsets)


def _words(raw: np.ndarray, inside: np.ndarray, offsets: np.ndarray, at: int, to: int, fold_case: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words in raw[at:to], which no word leaves but at a text's edge."""
    inside, n = inside[at:to], to - at
    before = np.append(False, inside[:-1])
    after = np.append(inside[1:], False)
    edges = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, "right")] - at
    before[edges[edges < n]] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_BYTE_FOLDED if fold_case else _BYTE)[raw[at:to]] * power[:n], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD)
    return starts + at, ends + at, hashes


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every k-word window; a text of 1 to k-1 words has one, its whole sequence."""
    h = words.hashes
    doc = np.repeat(np.arange(len(words.counts)), words.counts)
    n = len(h) - k + 1
    if n > 0:
        value = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            value = mix64(value + h[i : n + i] + _PLACE[i])
        whole = doc[:n] == doc[k - 1 :]
        doc_of, value = doc[:n][whole], value[whole]
    else:
        doc_of, value = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        tail = np.zeros(len(short), dtype=np.uint64)
        for i in range(k - 1):
            at = words.first[short] + i
            live = i < words.counts[short]
            tail[live] = mix64(tail[live] + h[at[live]] + _PLACE[32 + i])
        doc_of, value = np.concatenate([doc_of, short]), np.concatenate([value, tail])
    return doc_of, value


def span_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each sequence of words first[i]:last[i], the same wherever it stands."""
    power, inverse = _powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=total[1:])
    return mix64((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64) * _ODD)


def distinct_pairs(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, value), by doc and value."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), dtype=bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[keep], value[keep]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of the column's text, at least one row each."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    total = np.cumsum(sizes)
    at, done = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
        yield batch.slice(at, to - at)
        at, done = to, int(total[to - 1])
