"""BPE with word ends: a segment tree over adjacent pair ranks, whose root is the leftmost pair of the lowest rank."""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructType
from tokenizers import Tokenizer

from emberway.llm._store import small_batches
from emberway.llm._words import parts

CACHE = 200_000  #: pieces of text that a worker remembers: about 100 MB
REMEMBERED = 100  #: characters of the longest piece that is remembered
NONE, PLACE = 1 << 40, (1 << 32) - 1
FAN = 16  #: children of a node
LATIN = "\u0250"  #: characters before this one have no composition, and their letters and lower case are settled


@lru_cache(2)
def shared(path: str) -> WordBpe:
    """One coder for all tasks of a worker, so that they have its memory of pieces in common."""
    return WordBpe(path)


class WordBpe:
    """Encoder and decoder for a tokenizer file whose model is BPE with a suffix at word ends.

    The file's own normaliser and splitter prepare a text; merges are made here.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["unk_token"] or model["byte_fallback"] or model["continuing_subword_prefix"] or spec["decoder"]:
            raise ValueError(f"{path} has another kind of model than BPE with word ends")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that are not matched as they stand")
        whole = Tokenizer.from_file(path)
        self.normal, self.split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        kinds = [k["type"] for k in (*spec["normalizer"]["normalizers"], *spec["pre_tokenizer"]["pretokenizers"])]
        if kinds != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]:
            raise ValueError(f"{path} prepares texts in another way than by NFC, lower case and a split into bytes")
        self.find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.letters = {c: w[0][0] for c in range(ord(LATIN)) if (w := self.split(chr(c)))}
        self.ids, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.added).items()}
        self.find_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.merges: dict[tuple[int, int], int] = {}
        self.result: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[a], self.ids[b]] = rank
            self.result.append(self.ids[a + b])
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, symbols: list[int]) -> list[int]:
        """symbols after all merges: again and again the leftmost pair of the lowest rank becomes one symbol.

        Leaf i of the tree has the rank of the pair of symbol i and the live one after it, a node the
        least of its FAN children, the leftmost one if equal, so the root has the pair to merge. A merge
        changes three leaves (its own, that of the symbol merged away, that of the live one before),
        and the nodes above them. The symbol of a pair stays at its left place. A word of at most
        FAN pairs is a root with its leaves alone; there, leaves of symbols merged away are taken out.
        """
        n, get, result = len(symbols), self.merges.get, self.result
        leaves = list(map(get, zip(symbols, symbols[1:]), repeat(NONE)))
        if n <= FAN + 1:
            while leaves and (rank := min(leaves)) != NONE:
                i = leaves.index(rank)
                symbols[i : i + 2] = (result[rank],)
                del leaves[i]
                if i < len(leaves):
                    leaves[i] = get((symbols[i], symbols[i + 1]), NONE)
                if i:
                    leaves[i - 1] = get((symbols[i - 1], symbols[i]), NONE)
            return symbols
        # a leaf is rank * 2**32 + place, so that the lesser of two is the lower rank, or the one further left
        leaves = [rank << 32 | i for i, rank in enumerate(leaves)]
        after, before, none = list(range(1, n + 1)), list(range(-1, n)), NONE << 32
        tree = [leaves]
        while len(tree[-1]) > 1:
            tree.append([min(tree[-1][k : k + FAN]) for k in range(0, len(tree[-1]), FAN)])
        while (top := tree[-1][0]) < none:
            i = top & PLACE
            gone, old = after[i], before[i]
            symbols[i], after[i] = result[top >> 32], after[gone]
            if gone < n - 1:
                leaves[gone] = none
            if after[i] < n:
                before[after[i]] = i
                leaves[i] = get((symbols[i], symbols[after[i]]), NONE) << 32 | i
            else:
                leaves[i] = none
            if old >= 0:
                leaves[old] = get((symbols[old], symbols[i]), NONE) << 32 | old
            nodes = {min(gone, n - 2) // FAN, i // FAN, max(old, 0) // FAN}
            for below, own in zip(tree, tree[1:]):
                for k in nodes:
                    own[k] = min(below[k * FAN : (k + 1) * FAN])
                nodes = {k // FAN for k in nodes}
        out, i = [], 0
        while i < n:
            out.append(symbols[i])
            i = after[i]
        return out

    def word(self, word: str) -> bytes:
        """Ids of one word of the splitter: its last character has the suffix of word ends."""
        if (found := self.words.get(word)) is None:
            symbols = list(map(self.ids.__getitem__, word))
            symbols[-1] = self.ids[word[-1] + self.suffix]
            symbols = self.merged(symbols)
            found = struct.pack(f"<{len(symbols)}I", *symbols)
            if len(word) <= REMEMBERED:
                if len(self.words) > CACHE:
                    self.words.clear()
                self.words[word] = found
        return found

    def plain(self, text: str) -> bytes:
        low = text.lower()
        if text.isascii() or max(text) < LATIN and max(low) < LATIN:  # such texts are composed already, and libraries agree on their letters
            words = [w.translate(self.letters) for w in self.find(low)]
        else:
            words = [w for w, _ in self.split(self.normal(text))]
        return b"".join(map(self.word, words))

    def piece(self, text: str) -> bytes:
        """Ids of a piece without ASCII spaces; strings of added tokens in it are those tokens, and cut it."""
        if (found := self.known.get(text)) is not None:
            return found
        if self.find_added is None or "<" not in text:
            found = self.plain(text) if text else b""
        else:
            found = b"".join(struct.pack("<I", self.added[p]) if p in self.added else self.plain(p) for p in self.find_added(text) if p)
        if len(text) <= REMEMBERED:
            if len(self.known) > CACHE:
                self.known.clear()
            self.known[text] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a text, as packed little-endian integers of 32 bits.

        No word and no composed character spans white space, so the pieces between spaces are encoded alone.
        """
        pieces = text.replace("\n", " ").split(" ")
        found = list(map(self.known.get, pieces))
        if None in found:
            found = [self.piece(p) if ids is None else ids for p, ids in zip(pieces, found)]
        return b"".join(found)

    def decode(self, ids: list[int]) -> str:
        """The tokens of ids, word ends and all, joined by one space; ids that the file does not have are left out."""
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def encode(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """doc_id, ids (array, if asked for), n_tokens, ids_sha256, decoded_sha256: one row per row of docs.

    path: a tokenizer file that every worker can read. Texts are read whole; null and empty texts,
    and those of white space alone, have no tokens. Strings of added tokens in a text are those
    tokens. ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256
    over the text that the ids decode to. Repeated rows give repeated rows, a null doc_id stays
    null; other columns, whatever their names, are not read. An empty table gives no rows.
    Spark keeps the row order and does not shuffle; a text takes the memory of its ids, and a worker up
    to CACHE remembered pieces.
    """
    schema = "doc_id long" + ", ids array<int>" * ids + ", n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for rows in parts(batch):
                out = []
                for text in rows.column("text").to_pylist():
                    packed = bpe.encode(text or "")
                    got = np.frombuffer(packed, "<u4").tolist()
                    out.append((*([got] if ids else []), len(got), sha(packed), sha(bpe.decode(got).encode())))
                kinds = [*([pa.list_(pa.int32())] if ids else []), pa.int64(), pa.string(), pa.string()]
                names = ["doc_id", *(["ids"] if ids else []), "n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=names)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows with text: what their ids (array<int>) decode to; null ids give null. Other columns stay, but for one named text."""
    names = [c for c in rows.columns if c.lower() != "text"]
    small_batches(rows.sparkSession)
    rows = rows.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(path)
        for batch in batches:
            texts = [None if ids is None else bpe.decode(ids) for ids in batch.column(names.index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("text", StringType()))
