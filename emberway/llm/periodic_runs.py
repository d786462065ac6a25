"""Periodic runs of words: aligned blocks, searched for by an automaton, seed exact extensions to both sides."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberway.llm._store import small_batches
from emberway.llm._words import mixed, parts

TIMES, LEAST = 4, 6  #: a run is at least so many periods and so many words long
ALPHABET = 64  #: letters of each of the alphabets that spell a word's number, so that no node of an automaton has more children


def gaps(ids: np.ndarray) -> np.ndarray:
    """How many words further on each word occurs again; the number of words if it does not."""
    n = len(ids)
    order = np.argsort(ids.astype(np.uint16) if n <= 1 << 16 else ids, kind="stable")
    out = np.full(n, n, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def letters(ids: np.ndarray, n_ids: int) -> tuple[np.ndarray, int]:
    """Numbers below n_ids, each spelt by as many letters, every place with an alphabet of its own, and how many.

    No letter of one place occurs at another, so a block is found at the beginnings of words only.
    """
    width = 1
    while ALPHABET**width < n_ids:
        width += 1
    out = np.empty((len(ids), width), np.int64)
    for k in range(width):
        out[:, k] = ids // ALPHABET**k % ALPHABET + k * ALPHABET
    return out.ravel(), width


def occurrences(ids: np.ndarray, blocks: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and places of the blocks' occurrences that begin `length` to 2 * length - 1 words after any of them, sorted, and the number of each block.

    blocks are places of `length` words, in order; blocks of equal words have one number.
    """
    # stretches of the document in which an occurrence would count
    begin, end = blocks + length, np.minimum(blocks + 3 * length - 1, len(ids))
    new = np.ones(len(blocks), bool)
    new[1:] = begin[1:] > end[:-1]
    first = np.flatnonzero(new)
    stretches = list(zip(begin[first].tolist(), end[np.append(first[1:] - 1, len(end) - 1)].tolist()))
    used = np.unique(np.concatenate([ids[b : b + length] for b in blocks.tolist()]))
    rank = np.full(int(ids.max()) + 1, len(used), np.int64)  # words of no block share a number
    rank[used] = np.arange(len(used))
    width = letters(rank[:0], len(used) + 1)[1]
    spell = lambda lo, hi: tuple(letters(rank[ids[lo:hi]], len(used) + 1)[0].tolist())
    automaton, numbers = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), []
    for b in blocks.tolist():
        key = spell(b, b + length)
        found = automaton.get(key, None)
        if found is None:
            found = len(automaton)
            automaton.add_word(key, found)
        numbers.append(found)
    automaton.make_automaton()
    which, where = [], []
    for lo, hi in stretches:
        for at, number in automaton.iter(spell(lo, hi)):
            which.append(number)
            where.append(lo + (at + 1) // width - length)
    which, where = np.array(which, np.int64), np.array(where, np.int64)
    order = np.lexsort((where, which))
    return which[order], where[order], np.array(numbers, np.int64)


def extended(ids: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """First word and end of the stretch around `at` in which words `period` apart are identical."""
    n = len(ids) - period
    end, step = at, 64
    while end < n:
        some = ids[end : min(end + step, n)] != ids[end + period : min(end + step, n) + period]
        if some.any():
            end += int(some.argmax())
            break
        end, step = end + len(some), 2 * step
    start, step = at, 64
    while start > 0:
        low = max(0, start - step)
        some = (ids[low:start] != ids[low + period : start + period])[::-1]
        if some.any():
            start -= int(some.argmax())
            break
        start, step = low, 2 * step
    return start, end + period


def runs(ids: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period. times must be at least 4.

    Runs with a period from s = 2**k to 2 * s - 1 hold a block of s words at a multiple of s that begins
    less than s words after the run does, and hold it again one period on. So, scale by scale:

    1. Blocks each word of which occurs again within 2 * s words are compiled into an automaton, but for
       those so deep within a run of a shorter period that they could only seed that run again.
    2. The automaton searches the document from s words after each block on; an occurrence s to 2 * s - 1
       words after a block is a seed: a place and a period.
    3. Sums of hashes rule out seeds whose words do not recur for three periods, less s.
    4. What is left is extended to both sides, word by word; it counts if long enough and no run of
       a shorter period.
    """
    n = len(ids)
    if n < least:
        return []
    found: list[tuple[int, int, int]] = []
    extents: set[tuple[int, int]] = set()
    longest, sums, powers, s = gaps(ids), None, None, 1
    while times * s <= n:
        whole = n // s
        # the longest gap of each block of s words, from those of half the size
        longest = longest[:whole] if s == 1 else np.maximum(longest[0 : 2 * whole : 2], longest[1 : 2 * whole : 2])
        blocks = np.flatnonzero(longest < 2 * s) * s
        blocks = blocks[blocks + 2 * s <= n]
        for a, length, q in found:
            if len(blocks):
                lo, hi = np.searchsorted(blocks, (a, a + length - 2 * s - q + 1))
                if lo < hi:
                    blocks = np.delete(blocks, slice(lo, hi))
        if len(blocks):
            which, where, numbers = occurrences(ids, blocks, s)
            key = which * (n + 1) + where
            lo = np.searchsorted(key, numbers * (n + 1) + blocks + s)
            hi = np.searchsorted(key, numbers * (n + 1) + np.minimum(blocks + 2 * s, n + 1))
            each = hi - lo
            if each.sum():
                at = np.repeat(blocks, each)
                period = where[np.repeat(lo - np.append(0, np.cumsum(each)[:-1]), each) + np.arange(each.sum())] - at
                fits = at + times * period - s <= n
                at, period = at[fits], period[fits]
                if sums is None:
                    powers = np.full(n + 1, 0x9E3779B97F4A7C15, np.uint64)
                    powers[0] = 1
                    powers = np.cumprod(powers)
                    sums = np.append(np.uint64(0), np.cumsum(mixed(ids.astype(np.uint64) + np.uint64(1)) * powers[:n]))
                stop = at + (times - 1) * period - s
                alike = (sums[stop] - sums[at]) * powers[period] == sums[stop + period] - sums[at + period]
                at, period = at[alike], period[alike]
                order = np.lexsort((at, period))
                done, last = 0, 0
                for p, q in zip(at[order].tolist(), period[order].tolist()):
                    if q == last and p < done:
                        continue
                    start, end = extended(ids, p, q)
                    last, done = q, end - q
                    if end - start >= max(least, times * q) and (start, end) not in extents:
                        extents.add((start, end))
                        found.append((start, end - start, q))
        s *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period; of equal ones that which starts first, then the shorter period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers: the place of the first one."""
    return np.array(list(map({}.setdefault, words, count())), np.int64)


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """words without those that lie in a run after its first period."""
    kept = np.ones(len(words), bool)
    for start, length, period in found:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


FIELDS = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("n_dropped", pa.int64())]
FOUND = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_dropped long"


def find_runs(docs: DataFrame, runs_too: bool = False, texts: bool = False) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, n_dropped and, if asked
    for, runs (array of start, length, period) and collapsed (the words left): one row per row of docs.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text, unchanged, numbered from 0. A run is a stretch of at
    least max(6, 4 * q) words with smallest period q that no neighbouring word extends. Dropped are
    words that lie in any run after its first q words. start, length and period are those of the run
    of the greatest length / period, null without runs; the digests never are: of no runs and of no
    words they are that of the empty string. Null and empty texts have no words. Repeated rows give
    repeated rows, a null doc_id stays null, other columns, whatever their names, are not read, and
    an empty table gives no rows. Documents are searched alone and not shuffled; one takes about
    40 times the memory of its text, and time n * log(n) in its n words.
    """
    schema = FOUND + ", runs array<struct<start: long, length: long, period: long>>" * runs_too + ", collapsed string" * texts
    one_run = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])
    fields = [*FIELDS, *([("runs", pa.list_(one_run))] if runs_too else []), *([("collapsed", pa.string())] if texts else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in parts(batch):
                out = []
                for text in rows.column("text").to_pylist():
                    words = text.encode().split() if text else []
                    found = runs(numbered(words))
                    left = collapsed(words, found) if found else words
                    top, text = best(found), b" ".join(left)
                    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
                    row = [len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), len(words) - len(left)]
                    if runs_too:
                        row.append([dict(zip(("start", "length", "period"), r)) for r in found])
                    if texts:
                        row.append(text.decode())
                    out.append(row)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(c, k) for c, (_, k) in zip(zip(*out), fields))], names=["doc_id", *(k for k, _ in fields)])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)
