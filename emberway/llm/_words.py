"""Words of many texts at once, by numpy over the bytes of an Arrow string column.

A word is a maximal run of bytes outside [\x20\x09-\x0D]; as these are ASCII, that is
the same as a run of characters in UTF-8. A word's hash is a sum of one random 64-bit number
for each of its (place, byte) pairs, drawn once from a seed: no polynomial, so that no two words
collide by their make, only by chance. Seeds 0 and 1 give two independent hashes, 128 bits in all.
A text's memory is about 40 bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 500_000  #: bytes of text hashed at a time; a longer text makes a block of its own
PLACES = 64  #: places of a word that have random numbers of their own; those of later ones are multiples
_NUMBERS = [np.random.default_rng(seed).integers(0, 1 << 64, PLACES * 256, np.uint64) for seed in (20, 21)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order."""
    h = a * np.uint64(0x9E3779B97F4A7C15)
    h += b
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


class Words:
    """Word bounds of a block of texts: starts, ends (bytes of data) and first (texts + 1 word numbers)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        n, self.offsets = len(data), offsets
        space = _SPACE[data]
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        before[inner], after[inner - 1] = True, True
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def sums(self, seed: int = 0) -> np.ndarray:
        """The numbers of all bytes up to each, as sums modulo 2**64."""
        n, lengths = len(self.data), np.diff(self.starts, append=len(self.data))
        lead = self.starts[0] if len(self.starts) else n
        place = np.arange(n, dtype=np.int64 if n >> 30 else np.int32)
        place[lead:] -= np.repeat(self.starts.astype(place.dtype), lengths)
        late = np.flatnonzero(place >= PLACES) if max(int(lengths.max(initial=0)), lead) > PLACES else place[:0]
        later = place[late] // PLACES
        place[late] %= PLACES
        place <<= 8
        place |= self.data
        each = _NUMBERS[seed].take(place, mode="clip")
        each[late] *= mixed(later.astype(np.uint64)) | np.uint64(1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(each, out=total[1:])
        return total

    def hashes(self, longest: int | None = None, seed: int = 0, sums: np.ndarray | None = None) -> np.ndarray:
        """A hash of each word, or of its first `longest` bytes."""
        total = self.sums(seed) if sums is None else sums
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        return mixed(total[ends] - total[self.starts] + (ends - self.starts).astype(np.uint64))

    def places(self, k: int) -> np.ndarray:
        """The number of the first word of each run of k words that lies in one text."""
        n = max(0, len(self.starts) - k + 1)
        last = np.repeat(self.first[1:], np.diff(self.first))[:n]
        return np.flatnonzero(np.arange(n) + k <= last)

    def runs(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of k words that lie in one text, and the number of each run's first word.

        A run's hash is joined from those of runs of 1, 2, 4, ... words that it is made of.
        """
        n = len(hashes) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        whole, done, width, level = None, 0, 1, hashes
        while width <= k:
            if k & width:
                piece = level[done : done + n]
                whole, done = piece if whole is None else joined(whole, piece), done + width
            width *= 2
            if width <= k:
                level = joined(level[: -(width // 2)], level[width // 2 :])
        at = self.places(k)
        return mixed(whole[at] if len(at) < n else whole + np.uint64(0)), at


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of its rows) of a string column, in blocks; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts.cast(pa.large_string())
    if not len(texts):
        return
    _, where, what = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def parts(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most so many bytes of text, or one row."""
    if not batch.num_rows:
        return
    total = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(total, most + (total[i - 1] if i else 0), "right")))
        yield batch.slice(i, j - i)
        i = j
