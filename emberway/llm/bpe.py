"""Byte-level BPE: a segment tree over byte positions holds the leftmost minimum pair rank."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from emberway.llm._store import small_batches
from emberway.llm._words import parts

CACHE = 200_000  #: pieces of text, and words, that a worker remembers: about 100 MB
REMEMBERED = 200  #: characters of the longest piece that is remembered


NONE, POSITION = 1 << 62, (1 << 32) - 1
FAN = 16  #: children of a node


@lru_cache(2)
def shared(path: str, pattern: str) -> ByteBpe:
    """One coder for all tasks of a worker, so that they have its memory of pieces in common."""
    return ByteBpe(path, pattern)


class ByteBpe:
    """Encoder and decoder for a rank file; pattern splits a text before the merges."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocab = {v: k for k, v in self.ranks.items()}
        self.strings = {v: str(v) for v in self.vocab}
        self.find = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def merged(self, word: bytes) -> list[int]:
        """Ids of one match: again and again the leftmost pair of the lowest rank is merged.

        Leaf i of the tree holds the rank of the pair that begins at byte i, an inner node the
        least of its FAN children, the leftmost one if equal. A merge changes three leaves: the
        pair's own, that of the token to its left, and that of the token merged away; the nodes
        above them are taken anew, up to the root.
        """
        ranks = self.ranks
        if (whole := ranks.get(word)) is not None:
            return [whole]
        n, get = len(word), ranks.get
        end = list(range(1, n + 2))  # of the live token that begins at i
        prev = list(range(-1, n))
        # a leaf is rank * 2**32 + position, so that the lesser of two is the lower rank, or the one further left
        leaves = [NONE] * n
        for i in range(n - 1):
            if (r := get(word[i : i + 2])) is not None:
                leaves[i] = r << 32 | i
        tree = [leaves]
        while len(tree) == 1 or len(tree[-1]) > 1:
            tree.append([min(tree[-1][k : k + FAN]) for k in range(0, len(tree[-1]), FAN)])
        root = tree[-1]
        while (top := root[0]) != NONE:
            i = top & POSITION
            gone = end[i]
            end[i] = stop = end[gone]
            leaves[gone] = leaves[i] = NONE
            if stop < n:
                prev[stop] = i
                if (r := get(word[i : end[stop]])) is not None:
                    leaves[i] = r << 32 | i
            if (p := prev[i]) >= 0:
                leaves[p] = NONE if (r := get(word[p:stop])) is None else r << 32 | p
            if n <= FAN:
                root[0] = min(leaves)
                continue
            nodes = {gone // FAN, i // FAN, max(p, 0) // FAN}
            for below, own in zip(tree, tree[1:]):
                for k in nodes:
                    own[k] = min(below[k * FAN : (k + 1) * FAN])
                nodes = {k // FAN for k in nodes}
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def piece(self, text: str) -> list[int]:
        known, out = self.words, []
        if len(known) > CACHE:
            known.clear()
        for m in self.find(text):
            if (ids := known.get(m)) is None:
                ids = tuple(self.merged(m.encode()))
                if len(m) <= REMEMBERED:
                    known[m] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text. A single space between two characters that are no white space begins a
        match in any case, so that the text's pieces between such spaces can be encoded alone."""
        known, out = self.known, []
        if len(known) > CACHE:
            known.clear()
        get = known.get
        rest = iter(text.split(" "))
        now = next(rest)
        for part in rest:
            if part and now and not part[0].isspace() and not now[-1].isspace():
                out.append(get(now) or self.remembered(now))
                now = " " + part
            else:
                now += " " + part
        if now:
            out.append(get(now) or self.remembered(now))
        return list(chain.from_iterable(out))

    def remembered(self, text: str) -> tuple[int, ...]:
        ids = tuple(self.piece(text))
        if len(text) <= REMEMBERED:
            self.known[text] = ids
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))

    def joined(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


def encode(docs: DataFrame, path: str, pattern: str, ids: bool = True) -> DataFrame:
    """doc_id, ids (array, if asked for), n_tokens, ids_sha256, decoded_sha256: one row per row of docs.

    path: a rank file that every worker can read. Null and empty texts have no tokens. Texts are
    read whole; the memory of one is that of its ids. Special tokens' strings are ordinary text.
    ids_sha256 is over the decimal ids joined by one space, decoded_sha256 over the bytes that
    the ids decode to. Repeated rows give repeated rows; other columns are not read.
    """
    schema = "doc_id long" + ", ids array<int>" * ids + ", n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(path, pattern)
        for batch in batches:
            for rows in parts(batch):
                out = []
                for text in rows.column("text").to_pylist():
                    got = bpe.encode(text or "")
                    out.append((*([got] if ids else []), len(got), hashlib.sha256(bpe.joined(got).encode()).hexdigest(), hashlib.sha256(bpe.decode(got)).hexdigest()))
                kinds = [*([pa.list_(pa.int32())] if ids else []), pa.int64(), pa.string(), pa.string()]
                names = ["doc_id", *(["ids"] if ids else []), "n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=names)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)
