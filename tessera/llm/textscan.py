"""Vectorised word and byte scanning of Arrow string columns.

One pass of numpy over the UTF-8 buffer of a whole Arrow batch finds the words of all its texts and
gives each a 64-bit hash, with no Python work per word. A word is a maximal run of ASCII letters and
digits and of non-ASCII letters; general punctuation (U+2000..U+206F) and the Latin-1 signs
(U+0080..U+00BF but for ª µ º) separate words. Case is folded by default. Null texts have no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20  # texts are scanned in runs of about this many bytes; a longer text is a run of its own
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_P_INVERSE = pow(_P, -1, 1 << 64)

_LETTER = np.zeros(256, dtype=bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out


class _Powers:
    up = _powers(_P, 1024)
    down = _powers(_P_INVERSE, 1024)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers up to the nth, of which CHUNK_BYTES and a few are kept: hashes don't depend on where a run begins, so work is cut in runs."""
        most = CHUNK_BYTES + 1024
        if n > most:  # one word or span that is longer
            return _powers(_P, n), _powers(_P_INVERSE, n)
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_P, most), _powers(_P_INVERSE, most)
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of uint64."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """The words of `n` texts: word i has the bytes start[i]:end[i] of `data`, and text t has the words first[t]:first[t + 1]."""

    data: np.ndarray
    n: int
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; offsets count from the first byte of the array."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offs - offs[0], raw[offs[0] : offs[-1]]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, offsets, bytes) of runs of whole texts."""
    offs, raw = string_parts(column)
    i = 0
    while i < len(offs) - 1:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, j, offs[i : j + 1] - offs[i], raw[offs[i] : offs[j]]
        i = j


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words."""
    is_word = _LETTER[data]
    at = np.flatnonzero(data[:-2] == 0xE2) if len(data) > 2 else np.zeros(0, np.int64)
    at = at[(data[at + 1] == 0x80) | (data[at + 1] == 0x81)]
    for k in range(3):
        is_word[at + k] = False
    at = np.flatnonzero(data[:-1] == 0xC2) if len(data) > 1 else np.zeros(0, np.int64)
    at = at[~np.isin(data[at + 1], (0xAA, 0xB5, 0xBA))]
    for k in range(2):
        is_word[at + k] = False
    return is_word


def scan(offs: np.ndarray, data: np.ndarray) -> Words:
    """The words of the texts at `offs` in `data`, whose case is folded already."""
    n = len(offs) - 1
    padded = np.zeros(len(data) + 2, dtype=np.int8)
    padded[1:-1] = letters(data)
    edge = np.diff(padded)
    # a word ends where its text does
    starts_mask = edge[:-1] == 1
    ends_mask = edge[1:] == -1
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    joined = inner[(padded[inner + 1] == 1) & (padded[inner] == 1)]
    starts_mask[joined] = True
    ends_mask[joined - 1] = True
    start, end = np.flatnonzero(starts_mask), np.flatnonzero(ends_mask) + 1
    return Words(data, n, start, end, np.searchsorted(start, offs), _hashes(data, start, end))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word, in runs of words: a very long text takes no more memory here than a run."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + CHUNK_BYTES)))
        lo, hi = int(start[i]), int(end[j - 1])
        up, down = _Powers.get(hi - lo + 1)
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=total[1:])
        out[i:j] = mix((total[end[i:j] - lo] - total[start[i:j] - lo]) * down[start[i:j] - lo])
        i = j
    return out


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not this C library
    _trim = None


def release() -> None:
    """Freed memory goes back to the system: workers are reused, and what one task has freed another worker may need."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def words(column: pa.Array, fold: bool = True) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) of runs of whole texts of the column."""
    if column.nbytes > CHUNK_BYTES:
        release()
    if fold:
        column = pc.utf8_lower(column)
    for i, j, offs, data in chunks(column):
        yield i, j, scan(offs, data)


def hash_of(text: str) -> list[int]:
    """The word hashes of one text."""
    out: list[int] = []
    for _, _, w in words(pa.array([text], pa.large_string())):
        out += w.hash.tolist()
    return out


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive values: out[i] covers h[i : i + n]; empty when there are fewer than n."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(m, np.uint64)
    for lo in range(0, m, CHUNK_BYTES):
        hi = min(m, lo + CHUNK_BYTES)
        part = h[lo : hi + n - 1]
        up, down = _Powers.get(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        out[lo:hi] = mix((total[n:] - total[: hi - lo]) * down[: hi - lo])
    return out


def spans_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of h[lo[i] : hi[i]] for each i."""
    out = np.empty(len(lo), np.uint64)
    block = lo // CHUNK_BYTES
    for b in np.unique(block).tolist():
        of = np.flatnonzero(block == b)
        base = b * CHUNK_BYTES
        part = h[base : int(hi[of].max())]
        up, down = _Powers.get(max(len(part), CHUNK_BYTES) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        out[of] = mix((total[hi[of] - base] - total[lo[of] - base]) * down[lo[of] - base] + (hi[of] - lo[of]).astype(np.uint64))
    return out


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, ordinal) of sum(counts) items, counts[i] of which belong to i."""
    owner = np.repeat(np.arange(len(counts)), counts)
    begin = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.zeros(0, np.int64)
    return owner, np.arange(len(owner)) - begin[owner] if len(owner) else np.zeros(0, np.int64)
