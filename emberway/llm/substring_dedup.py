"""Substring dedup: recurring passages are confirmed, compiled into sharded automata, and located in all documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberway.llm._maps import HashSet
from emberway.llm._store import small_batches, written
from emberway.llm._words import Words, blocks, mixed

WINDOW = 35  #: words of a passage that counts as repeated
ANCHOR = 14  #: words of an anchor: a window's run of so many words with the least hash
HOT = 512  #: occurrences from which an anchor is told apart further, by whole windows
SHARD_BYTES = 16_000_000  #: text of the documents that share an automaton, about
TASK_BYTES = 64_000_000  #: text of the shards that one task takes one after another, about, beyond what keeps all tasks busy
LETTERS, WIDTH = 24, 3  #: letters of an alphabet and alphabets of the codes of an automaton's words; the last alphabet is as large as it must be


class Anchors:
    """Windows of a block of texts: hash and first word of each, and its anchor's hash and first word.

    With check, 32 more bits of each window, joined from its words in another way.
    """

    def __init__(self, words: Words, window: int, anchor: int, check: bool = False):
        h = words.hashes()
        self.words, self.window, self.h = words, window, h
        self.at = words.places(window)
        if check:
            self.check = (words.runs(window, mixed(h ^ np.uint64(0x5851F42D4C957F2D)))[0] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        grams, first = words.runs(anchor, h)
        place = np.full(len(h) + 1, 0, np.int64)
        place[first] = np.arange(len(first))
        span = window - anchor + 1
        if len(self.at):
            # the leftmost least of each window's grams; a window's grams lie side by side
            chosen = leftmost_least(grams, span)[place[self.at]]
            self.anchor, self.anchor_at = grams[chosen], first[chosen]
        else:
            self.anchor, self.anchor_at = np.empty(0, np.uint64), np.empty(0, np.int64)

    @cached_property
    def hash(self) -> np.ndarray:
        return self.words.runs(self.window, self.h)[0]


def leftmost_least(values: np.ndarray, span: int) -> np.ndarray:
    """Of each `span` values side by side, the place of the least one, the leftmost if equal."""
    at, width = np.arange(len(values), dtype=np.int32), 1
    while width < span:
        step = min(width, span - width)
        a, b = values[:-step], values[step:]
        later = b < a
        values, at = np.where(later, b, a), np.where(later, at[step:], at[:-step])
        width += step
    return at


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _runs_of(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


def _scan(docs: DataFrame, each, schema: str, window: int, anchor: int, check: bool = False) -> DataFrame:
    """each(anchors, words, texts' ids) gives the columns of its rows, in blocks of documents."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("row").to_numpy()
            for at, data, offsets in blocks(batch.column("text")):
                words = Words(data, offsets)
                yield pa.RecordBatch.from_arrays(each(Anchors(words, window, anchor, check), words, ids[at : at + len(offsets) - 1]), names=names)

    return docs.select("row", "text").mapInArrow(run, schema)


def dealt(size: int, shard_bytes: int, partitions: int) -> tuple[int, int]:
    """Shards and tasks for so many bytes of text: every task takes as many shards, of 1.25 times shard_bytes at most."""
    shards = max(1, -(-size // shard_bytes))
    tasks = min(shards, max(partitions, -(-size // TASK_BYTES)))
    return tasks * max(1, -(-(4 * shards - tasks) // (4 * tasks))), tasks


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES, hot: int = HOT, texts: bool = True) -> DataFrame:
    """row (numbers the rows), doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept: one row per row of docs.

    A word is removed if it lies in a window of `window` words whose word sequence also starts
    anywhere else, in the same document or another; all windows are those of the input. kept is
    the words left, joined by one space. Words are [^\\x20\\x09-\\x0D]+, unchanged; null and empty
    texts have none, texts shorter than a window lose none. Rows that repeat a doc_id are documents
    of their own. Other columns are not read; an empty table gives no rows.

    1. Every window names an anchor: its run of `anchor` words with the least hash. Anchors that
       occur once cannot lie in a recurring window. A bounded map tells the others.
    2. Windows with such an anchor are counted, told apart by 96 bits; each that recurs belongs to
       the least row that has it. In a row, windows of its own with one anchor, side by side, are a phrase.
    3. Documents are dealt into shards of bounded size. A phrase goes to the shards where its
       anchor occurs (for an anchor of `hot` occurrences or more: where one of its windows does).
    4. A shard compiles its phrases' anchors into an automaton over word numbers; each of its
       documents is streamed through it. From every hit the match is extended over equal words
       as far as the phrase goes; `window` words or more are removed.
    """
    spark = small_batches(docs.sparkSession)
    # written once: several jobs read the rows and must see the same numbers
    docs = written(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "docs", "zstd")

    # 1
    def own_anchors(a: Anchors, words: Words, ids: np.ndarray) -> list:
        new = _runs_of(a.anchor_at)
        return [_signed(a.anchor[new])]

    counts = written(_scan(docs, own_anchors, "anchor long", window, anchor).groupBy("anchor").count().where("count > 1"), "anchors")
    n, n_hot = counts.agg(F.count("*"), F.count(F.when(F.col("count") >= hot, 1))).first()
    common = spark.sparkContext.broadcast(HashSet(counts, "anchor", n))
    busy = spark.sparkContext.broadcast(HashSet(counts.where(F.col("count") >= hot), "anchor", n_hot))

    # 2
    def own_windows(a: Anchors, words: Words, ids: np.ndarray) -> list:
        some = np.flatnonzero(common.value.holds(a.anchor))
        at = a.at[some]
        doc = np.searchsorted(words.first, at, "right") - 1
        return [_signed(a.hash[some]), pa.array(a.check[some]), pa.array(ids[doc])]

    seen = _scan(docs, own_windows, "window long, check int, row long", window, anchor, True)
    first = seen.groupBy("window", "check").agg(F.count("*").alias("n"), F.min("row").alias("row")).where("n > 1")
    places = written(first.groupBy("row").agg(F.collect_list("window").alias("windows")), "places")

    def keys(a: Anchors, at: np.ndarray) -> np.ndarray:
        hot = busy.value.holds(a.anchor[at])
        return np.where(hot, mixed(a.hash[at] + np.uint64(1)), a.anchor[at]) if hot.any() else a.anchor[at]

    def phrase_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("windows")
            out = []
            for at, data, offsets in blocks(batch.column("text")):
                words = Words(data, offsets)
                a = Anchors(words, window, anchor)
                home = np.searchsorted(a.at, words.first)
                for k in range(len(offsets) - 1):
                    hashes = a.hash[home[k] : home[k + 1]]
                    there = np.flatnonzero(np.isin(hashes, lists[at + k].values.to_numpy().view(np.uint64)))
                    own = home[k] + np.sort(there[np.unique(hashes[there], return_index=True)[1]])
                    # windows of one anchor side by side make a phrase, up to the last window's end
                    cut = np.ones(len(own), bool)
                    cut[1:] = (np.diff(own) != 1) | (a.anchor_at[own[1:]] != a.anchor_at[own[:-1]])
                    begin = np.flatnonzero(cut)
                    key = keys(a, own)
                    for i, j in zip(begin, np.append(begin[1:], len(own))):
                        lo, hi = a.at[own[i]], a.at[own[j - 1]] + window
                        text = b" ".join(data[words.starts[x] : words.ends[x]].tobytes() for x in range(lo, hi))
                        out.append((np.unique(key[i:j]).view(np.int64), text, int(a.anchor_at[own[i]] - lo)))
            columns = list(zip(*out)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.list_(pa.int64())), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int32())], names=["keys", "phrase", "offset"])

    # only rows that own a window move to the join
    home = spark.sparkContext.broadcast(HashSet(places.select(F.xxhash64("row").alias("h")), "h", places.count()))

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(home.value.holds(batch.column("h").to_numpy())))
            yield own.select(["row", "text"])

    owners = docs.select("row", "text", F.xxhash64("row").alias("h")).mapInArrow(at_home, "row long, text string")
    source = owners.join(places, "row").select("text", "windows")
    phrases = source.mapInArrow(phrase_rows, "keys array<long>, phrase binary, offset int")
    phrases = written(phrases.withColumn("id", F.monotonically_increasing_id()), "phrases", "zstd")

    # 3
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards, n_tasks = dealt(size, shard_bytes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shard_of = F.pmod(F.xxhash64("row"), F.lit(n_shards)).cast("int")

    def own_keys(a: Anchors, words: Words, ids: np.ndarray) -> list:
        some = np.flatnonzero(common.value.holds(a.anchor))
        key = keys(a, some)
        new = _runs_of(key)
        doc = np.searchsorted(words.first, a.at[some][new], "right") - 1
        return [_signed(key[new]), pa.array(ids[doc])]

    there = _scan(docs, own_keys, "key long, row long", window, anchor).select("key", shard_of.alias("shard")).distinct()
    keyed = phrases.select("id", F.explode("keys").alias("key")).join(there, "key").select("id", "shard").distinct()
    sent = phrases.select("id", "phrase", "offset").join(keyed, "id")
    sent = sent.select("shard", F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("doc_id"), F.col("phrase").alias("data"), "offset")
    told = docs.select(shard_of.alias("shard"), "row", "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"), F.lit(-1).alias("offset"))
    rows = sent.unionByName(told).repartitionById(n_tasks, F.col("shard") % n_tasks).sortWithinPartitions("shard", F.desc("offset"))
    schema = "row long, doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"

    # 4
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, machine = None, Machine(window, anchor)
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("shard", "row", "doc_id", "offset")]
            for s, row, doc_id, offset, data in zip(*columns, batch.column("data")):
                if s != shard:
                    shard, machine = s, Machine(window, anchor)
                if offset >= 0:
                    machine.add(data.as_py(), offset)
                    continue
                words = data.as_py().split()
                gone = machine.covered(words)
                kept = b" ".join([w for w, g in zip(words, gone) if not g] if gone.any() else words)
                out.append((row, doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            done = list(zip(*out)) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(done, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    told = rows.select("shard", "row", "doc_id", "offset", "data").mapInArrow(locate, schema)
    return told if texts else told.drop("kept")


class Machine:
    """An automaton over the phrases' anchors. A word is a code of WIDTH characters, one of each of WIDTH alphabets,

    as the automaton looks through a node's children one by one; matches so begin at words only.
    """

    def __init__(self, window: int, anchor: int):
        self.window, self.anchor = window, anchor
        self.codes: dict[bytes, str] = {}
        self.phrases: dict[str, list[tuple[str, int]]] = {}
        self.automaton = None

    def code(self, word: bytes) -> str:
        if (c := self.codes.get(word)) is None:
            n = len(self.codes)
            c = self.codes[word] = "".join(chr(1 + LETTERS * k + (n // LETTERS**k) % LETTERS) for k in range(WIDTH - 1)) + chr(1 + LETTERS * (WIDTH - 1) + n // LETTERS ** (WIDTH - 1))
        return c

    def add(self, phrase: bytes, offset: int) -> None:
        get, code = self.codes.get, self.code
        text = "".join([get(w) or code(w) for w in phrase.split()])
        self.phrases.setdefault(text[offset * WIDTH : (offset + self.anchor) * WIDTH], []).append((text, offset * WIDTH))

    def covered(self, words: list[bytes]) -> np.ndarray:
        """Which words lie in a recurring window."""
        out = bytearray(len(words))
        if not self.phrases or len(words) < self.window:
            return np.frombuffer(out, bool)
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for key, found in self.phrases.items():
                self.automaton.add_word(key, sorted(found, key=lambda f: -len(f[0])))
            self.automaton.make_automaton()
        get, other = self.codes.get, "\0" * WIDTH
        # a word that no phrase has ends every match, so only runs of other words are gone through
        at = 0
        for text in "".join([get(w, other) for w in words]).split(other):
            if len(text) >= self.window * WIDTH:
                self.mark(text, out, at // WIDTH)
            at += len(text) + WIDTH
        return np.frombuffer(out, bool)

    def mark(self, text: str, out: bytearray, first: int) -> None:
        """Sets out, from word `first`, for the words of text that lie in a recurring window.

        A phrase that could only cover words that are set already, or too few, is not compared.
        """
        for last, found in self.automaton.iter(text):
            end = last + 1
            at = end - self.anchor * WIDTH
            for phrase, offset in found:
                lo, hi = at - offset, at - offset + len(phrase)
                a, b = max(lo, 0) // WIDTH, min(hi, len(text)) // WIDTH
                if b - a < self.window or out.find(0, first + a, first + b) < 0:
                    continue
                if lo < 0 or not text.startswith(phrase, lo):
                    after = offset + end - at
                    lo = at - alike(text[max(lo, 0) : at][::-1], phrase[:offset][::-1])
                    hi = end + alike(text[end:hi], phrase[after:])
                if hi - lo >= self.window * WIDTH:
                    lo, hi = lo // WIDTH, hi // WIDTH
                    out[first + lo : first + hi] = b"\1" * (hi - lo)


def alike(a: str, b: str) -> int:
    """Characters of the words that a and b begin with alike."""
    lo, hi = 0, min(len(a), len(b)) // WIDTH
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[: mid * WIDTH] == b[: mid * WIDTH]:
            lo = mid
        else:
            hi = mid - 1
    return lo * WIDTH
