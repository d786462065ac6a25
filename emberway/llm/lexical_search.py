"""Ranked lexical search: each term has a tree of maxima over ranges of documents, descended best first."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberway.llm._store import small_batches, written
from emberway.llm._words import parts

FAN = 16  #: children of a node
BLOCK = 16_384  #: documents that share a tree, at most
ENTRIES = 4_000_000  #: and their terms together, about
TERMS = 1 << 20  #: distinct terms of the items that are ranked in one pass over the documents, about
FIRST = 16  #: one document in so many is ranked before the others, to find the scores that these must reach

#: bytes of a text: ASCII letters and digits, letters in lower case, and all of other characters; the rest are separators
_FOLD = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in bytes(range(256)).lower())


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of any characters beyond ASCII, A-Z in lower case."""
    return text.encode().translate(_FOLD).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to a score for each unit of its weight; integers of 64 bits throughout."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * (50 + 50 * n * n_docs // n_terms))


class Trees:
    """A block of documents: for every term the greatest impact in each range of FAN**j documents that has it.

    Level 0 has an entry for each term of each document, by term and document; an entry of level j
    stands for a term and a node, a range of FAN nodes below, with the greatest value among its
    entries there, which lie side by side from first[j][entry] on. The top level has one node.
    """

    def __init__(self, ids: np.ndarray, term: np.ndarray, doc: np.ndarray, value: np.ndarray):
        # documents with the same frequent terms, thus of one language and kind, come side by side
        frequent = np.argsort(-np.bincount(term))[:12]
        traits = np.zeros((len(ids), len(frequent)), bool)
        for k, t in enumerate(frequent):
            traits[doc[term == t], k] = True
        strongest = np.zeros(len(ids), np.int64)
        np.maximum.at(strongest, doc, value)
        order = np.lexsort((strongest, *traits.T[::-1]))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, node = ids[order], place[doc]
        by = np.lexsort((node, term))
        term, node, value = term[by], node[by], value[by]
        self.node, self.value, self.first = [node], [value], [None]
        size = len(ids)
        while size > 1:
            size = -(-size // FAN)
            up = node // FAN
            new = np.ones(len(up), bool)
            new[1:] = (up[1:] != up[:-1]) | (term[1:] != term[:-1])
            first = np.flatnonzero(new)
            value = np.maximum.reduceat(value, first)
            self.first.append(np.append(first, len(up)))
            term, node = term[first], up[first]
            self.node.append(node)
            self.value.append(value)
        self.term = term

    def top(self, own: np.ndarray, weights: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """(score, document's id) of the k best documents, ties to smaller ids, for terms and weights of an item; those below floor are left out.

        A node's bound is the sum of weights times maxima of the terms that it has; no document in
        its range has more. The node of the highest bound is opened first, until none reaches the
        k-th score; an equal bound is opened, as a smaller id may lie there.
        """
        at = np.searchsorted(self.term, own)
        there = (at < len(self.term)) & (self.term[np.minimum(at, len(self.term) - 1)] == own)
        entries, weights = at[there], weights[there]
        found: list[tuple[int, int]] = []  # a heap of (score, -id): the worst is first
        height = len(self.node) - 1
        bound = int((weights * self.value[height][entries]).sum())
        nodes = [(-bound, 0, height, entries, weights)] if bound > 0 else []
        turn = 0
        while nodes and -nodes[0][0] >= max(floor, found[0][0] if len(found) == k else 1):
            _, _, level, entries, weights = heapq.heappop(nodes)
            below, children, own_weights = level - 1, entries, weights
            if level:
                first = self.first[level][entries]
                each = self.first[level][entries + 1] - first
                children = np.repeat(first - np.append(0, np.cumsum(each)[:-1]), each) + np.arange(each.sum())
                own_weights = np.repeat(weights, each)
            else:
                below = 0
            node = self.node[below][children]
            low = int(node.min()) // FAN * FAN
            scores = np.zeros(FAN, np.int64)
            np.add.at(scores, node - low, own_weights * self.value[below][children])
            needed = max(floor, found[0][0] if len(found) == k else 1)
            for child in np.flatnonzero(scores >= needed).tolist():
                score = int(scores[child])
                if below:
                    some = node == low + child
                    turn += 1
                    heapq.heappush(nodes, (-score, turn, below, children[some], own_weights[some]))
                elif len(found) < k:
                    heapq.heappush(found, (score, -int(self.ids[low + child])))
                else:
                    heapq.heappushpop(found, (score, -int(self.ids[low + child])))
        return [(s, -i) for s, i in found]


def _counted(docs: DataFrame, numbers) -> DataFrame:
    """Per document with terms: row, doc_id, n, and numbers and counts of its terms that items have, as packed integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for batch in batches:
            for rows in parts(batch):
                keep, out = [], []
                for i, text in enumerate(rows.column("text").to_pylist()):
                    words = terms(text)
                    if words:
                        tf = Counter(words)
                        own = [(known[t], tf[t]) for t in (tf.keys() & known.keys())]
                        keep.append(i)
                        out.append((len(words), *(np.array(x, "<i4").tobytes() for x in (zip(*own) if own else ((), ())))))
                some = rows.select(["row", "doc_id"]).take(pa.array(keep, pa.int64()))
                n, term, count = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(n, pa.int64()), pa.array(term, pa.binary()), pa.array(count, pa.binary())], names=["row", "doc_id", "n", "term", "tf"])

    return docs.mapInArrow(run, "row long, doc_id long, n long, term binary, tf binary")


def _frequencies(counted: DataFrame) -> DataFrame:
    """number, df: the documents that hold each term, added up over every task's own sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            some = np.bincount(np.frombuffer(b"".join(batch.column("term").to_pylist()), "<i4"), minlength=len(total))
            some[: len(total)] += total
            total = some
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["number", "df"])

    return counted.select("term").mapInArrow(run, "number long, df long").groupBy("number").agg(F.sum("df").alias("df"))


def _ranked(counted: DataFrame, asked, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item, row, doc_id, score: each block's k best documents of each item that reach the item's floor."""

    def answer(tables: list[pa.RecordBatch], floors: dict[int, list[int]]) -> pa.RecordBatch:
        table = pa.Table.from_batches(tables)
        lists = table.column("term").to_pylist()
        term, tf = (np.frombuffer(b"".join(x), "<i4").astype(np.int64) for x in (lists, table.column("tf").to_pylist()))
        doc = np.repeat(np.arange(len(lists)), [len(x) // 4 for x in lists])
        rows, n = table.column("row").to_numpy(), table.column("n").to_numpy()
        ids = table.column("doc_id").to_pylist()
        # places by doc_id, nulls last, then by row, so that a smaller place wins a tie
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, rows[i]))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        out = []
        if len(term):
            trees = Trees(place, term, doc, impact(tf, n[doc], n_docs, n_terms))
            for item, own, weights, floor in asked.value:
                best = floors.setdefault(item, [floor] * k)
                for score, p in trees.top(own, weights, k, max(best[0], floor)):
                    out.append((item, rows[order[p]], ids[order[p]], score))
                    heapq.heappushpop(best, score)
        item, row, doc_id, score = zip(*out) if out else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(row, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], names=["item", "row", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, entries, floors = [], 0, 0, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                held.append(some)
                size += some.num_rows
                entries += some.column("term").nbytes // 4
                if size + 1024 > BLOCK or entries > ENTRIES:
                    yield answer(held, floors)
                    held, size, entries = [], 0, 0
        if held:
            yield answer(held, floors)

    return counted.mapInArrow(run, "item long, row long, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, at_once: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents (doc_id, text) of each item (item_id, text).

    A document's score adds up weight times impact over the item's terms, once each (see terms,
    weight and impact); only scores above 0 count, equal ones go by doc_id, null last, then by row. Documents
    without terms, those of null and empty text too, are not counted. Every row of items is an
    item of its own, also where it repeats an item_id, every row of docs a document; items without
    terms have no rows, nor has any item if a table is empty. Texts are read whole; other columns,
    whatever their names, are not read.

    Items go by rounds of about `at_once` distinct terms (more only if one item has more), so that
    what is sent to the tasks is bounded; a round reads the documents once, writes their counts of
    the round's terms, and ranks blocks of documents where they lie, without a shuffle. A sixteenth of
    the documents is ranked first and gives each item a score that the others must reach.
    """
    spark = small_batches(docs.sparkSession)
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in parts(batch):
                lists = [sorted(set(terms(t))) for t in rows.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("item"), rows.column("item_id"), pa.array(lists, pa.list_(pa.binary()))], names=["item", "item_id", "terms"])

    items = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    items = written(items.mapInArrow(words, "item long, item_id long, terms array<binary>").where("size(terms) > 0"), "items")
    rounds = -(-(items.agg(F.sum(F.size("terms"))).first()[0] or 0) // at_once)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for turn in range(rounds):
        some = items.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == turn).select("item", "terms").collect()
        numbers = {bytes(t): i for i, t in enumerate(sorted({bytes(t) for r in some for t in r["terms"]}))}
        counted = written(_counted(docs, spark.sparkContext.broadcast(numbers)), "counted")
        n_docs, n_terms = counted.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        df = {r["number"]: r["df"] for r in _frequencies(counted).collect()}  # of the round's terms alone
        asked = []
        for r in some:
            own = np.array(sorted(numbers[bytes(t)] for t in r["terms"] if numbers[bytes(t)] in df), np.int64)
            asked.append((r["item"], own, np.array([weight(n_docs, df[t]) for t in own.tolist()], np.int64), 1))
        first = F.pmod(F.xxhash64("row"), F.lit(FIRST)) == 0
        begun = written(_best(_ranked(counted.where(first), spark.sparkContext.broadcast(asked), n_docs, n_terms, k), k).drop("rank"), "begun")
        floors = {r["item"]: r["low"] for r in begun.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") >= k).collect()}
        rest = spark.sparkContext.broadcast([(item, own, w, floors.get(item, 1)) for item, own, w, _ in asked])
        found = begun.unionByName(_ranked(counted.where(~first), rest, n_docs, n_terms, k))
        out = out.unionByName(_best(found, k).join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"))
    return out
