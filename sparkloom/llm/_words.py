"""Vectorised words and word n-gram hashes over Arrow string columns."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = x + np.uint64(salt & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(256, dtype=np.uint64), 0x5851F42D4C957F2D) | np.uint64(1)


def byte_table(separators: bytes) -> np.ndarray:
    """True for the bytes that belong to words."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: White space as in [\x20\x09-\x0D]; and all of ASCII that is neither letter nor digit.
SPACES = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
NOT_ALNUM = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SEGMENT + 1, 1 << (n - 1).bit_length()) + 1
    if size not in _POWERS:
        _POWERS.clear()
        inverse = pow(_BASE, -1, 2**64)
        with np.errstate(over="ignore"):
            both = []
            for base in (_BASE, inverse):
                a = np.full(size, base, dtype=np.uint64)
                a[0] = 1
                both.append(np.cumprod(a))
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


class Words:
    """Words of a slice of texts: byte places, document borders and one hash per word."""

    def __init__(self, texts: pa.Array, table: np.ndarray, detach: bool = False, lower: bool = True):
        """detach: a full stop or comma between an ASCII letter and a separator is a word of its own. lower: lower-case A-Z."""
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        _, offsets, data = texts.buffers()
        self.n = len(texts)
        off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        off = off - off[0]
        self.offsets, self.bytes = off, LOWER[raw] if lower else raw
        inside = table[self.bytes]
        border = np.zeros(len(inside) + 1, dtype=bool)
        border[off] = True
        start, end = inside.copy(), inside.copy()
        if len(inside):
            start[1:] &= ~inside[:-1] | border[1:-1]
            end[:-1] &= ~inside[1:] | border[1:-1]
        if detach and len(inside) > 1:
            b = self.bytes
            lone = ((b[1:] == 0x2E) | (b[1:] == 0x2C)) & (b[:-1] >= 0x61) & (b[:-1] <= 0x7A) & end[1:] & ~border[1:-1]
            start[1:] |= lone
            end[:-1] |= lone
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        #: words of document i: first[i] to first[i + 1]
        self.first = np.searchsorted(self.starts, off)
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.starts), dtype=np.uint64)
        at = 0
        while at < len(self.starts):
            low = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, low + SEGMENT, side="right")))
            piece = self.bytes[low : self.ends[to - 1]]
            up, down = _powers(len(piece))
            sums = np.empty(len(piece) + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE_VALUES[piece] * up[: len(piece)], out=sums[1:])
            s, e = self.starts[at:to] - low, self.ends[at:to] - low
            out[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
            at = to
        return mix(out)

    def grams(self, k: int) -> np.ndarray:
        """A hash for the k words from each word on; the last k - 1 of a document reach beyond it and mean nothing."""
        out = np.zeros(len(self.hashes), dtype=np.uint64)
        for j in range(k):
            out[: max(0, len(out) - j)] += mix(self.hashes[j:], 0xA24BAED4963EE407 * (j + 1))
            out *= np.uint64(0xD6E8FEB86659FD93)
        return mix(out, k)


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of documents of about `most` bytes of text; a longer document makes a run of its own."""
    if not len(texts):
        return
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield at, to
        at = to


def trim() -> None:
    """Hand freed memory back to the system, for workers that live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_scratch: dict[str, dict] = {}


def scratch(owner: str) -> dict:
    """What a worker keeps between tasks for one operator; another operator's is let go."""
    if owner not in _scratch:
        _scratch.clear()
        _POWERS.clear()
        _scratch[owner] = {}
        trim()
    return _scratch[owner]


def word_hash(words: list[str], k: int, table: np.ndarray) -> np.ndarray:
    """The k-gram hashes of one list of words, as Words has them."""
    w = Words(pa.array([" ".join(words)]), table)
    return w.grams(k)[: max(0, len(words) - k + 1)]
