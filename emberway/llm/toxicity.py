"""Toxicity by non-negative positive-unlabelled learning of a numpy classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberway.llm._store import small_batches, written
from emberway.llm._words import Words, blocks, mixed

LENGTHS = (4, 5, 6, 8, None)  #: a word's features: its first so many bytes, and all of them
POSITIVES, UNLABELLED = 4_000, 8_000  #: rows of the training sample, at most
LEAST, FEATURES = 4, 60_000  #: positive texts that a feature needs; features, at most (the most frequent ones)
APART = 5.0  #: standard errors by which a feature's share of the positive texts differs from that of the unlabelled ones
FILTER = 22  #: bits of the hash that the first look at a feature takes


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def features(texts: pa.Array, vocabulary: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each feature, feature) in blocks of texts, each feature once a text.

    With a vocabulary (sorted) a feature is its place there, and others are left out.
    """
    if vocabulary is not None:
        sieve = np.zeros(1 << FILTER, bool)
        sieve[(vocabulary >> np.uint64(64 - FILTER)).astype(np.int64)] = True
    for at, data, offsets in blocks(texts):
        words = Words(data, offsets, lower=True)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
        sums = words.sums()
        rows, found = [], []
        for k, longest in enumerate(LENGTHS):
            h = mixed(words.hashes(longest, sums=sums) + np.uint64(k + 1))
            r = row
            if vocabulary is not None:
                some = np.flatnonzero(sieve[(h >> np.uint64(64 - FILTER)).astype(np.int64)])
                h, r = h[some], row[some]
                place = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
                some = np.flatnonzero(vocabulary[place] == h) if len(vocabulary) else np.empty(0, np.int64)
                h, r = place[some], r[some]
            rows.append(r)
            found.append(h)
        rows, found = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((found, rows))
        rows, found = rows[order], found[order]
        once = np.ones(len(rows), bool)
        once[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
        yield at, len(offsets) - 1, rows[once], found[once]


def _lists(sample: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """positive, found: the places in the vocabulary of each row's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, rows, found in features(batch.column("text"), vocabulary):
                offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("positive").slice(at, n), lists], names=["positive", "found"])

    return sample.select("positive", "text").mapInArrow(run, "positive boolean, found array<long>")


def _counts(sample: DataFrame, vocabulary: np.ndarray | None) -> DataFrame:
    """f, n: rows of the sample that have a feature (its place, if there is a vocabulary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, found in features(batch.column("text"), vocabulary):
                f, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(n.astype(np.int64))], names=["f", "n"])

    return sample.select("text").mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))


class Model:
    """Score sigmoid(bias + the sum of the weights of a text's features)."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, bias: float):
        used = np.flatnonzero(weights)
        self.vocabulary, self.weights, self.bias = vocabulary[used], weights[used], bias

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for at, n, rows, found in features(texts, self.vocabulary):
            out[at : at + n] = self.bias + np.bincount(rows, self.weights[found], n)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit_nnpu(rows: np.ndarray, found: np.ndarray, positive: np.ndarray, n_features: int, prior: float, steps: int = 120, rate: float = 0.1, l1: float = 3e-4, beta: float = 0.0, gamma: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with logistic loss l:

    prior * mean_P l(g) + max(0, mean_U l(-g) - prior * mean_P l(-g)), by Adam over all rows.
    Where the second term has fallen below -beta, a step goes up its gradient instead, gamma
    times, so that it does not fit the unlabelled rows' noise. l1 draws unused weights to 0.
    """
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    w, b = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    share = np.where(positive, prior / n_p, 1.0 / n_u)
    for t in range(1, steps + 1):
        g = b + np.bincount(rows, w[found], len(positive))
        s = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
        soft = np.logaddexp(0, g)  # l(-g)
        rest = float(np.sum(np.where(positive, -share * soft, share * soft)))
        up = np.where(positive, -share * s, share * s)  # gradient of the second term
        grad = np.where(positive, -share * (1 - s), 0) + up if rest >= -beta else -gamma * up
        dw, db = np.bincount(found, grad[rows], n_features), float(grad.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * dw, 0.999 * v + 0.001 * dw**2, 0.9 * mb + 0.1 * db, 0.999 * vb + 0.001 * db**2
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        pace = rate * (1 - t / (steps + 1))
        step = pace / (np.sqrt(v / c2) + 1e-6)
        w = w - step * m / c1
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * l1)
        b -= pace * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    return w, b


def lowest(ids: DataFrame, n: int, k: int, seed: int) -> DataFrame:
    """The k rows of ids (doc_id, each once) of lowest hash, or all if there are fewer; n: about how many rows ids has.

    A bound on the hash, a fifth and a thousand above what gives k rows, goes before the sort, so that
    the one task that sorts gets some k rows however many tasks send to it.
    """
    h = F.xxhash64("doc_id", F.lit(seed))
    wanted = k + k // 5 + 1000
    if n > wanted:
        ids = ids.where(h <= F.lit(-(1 << 63) + (1 << 64) * wanted // n).cast("long"))
    return ids.orderBy(h, "doc_id").limit(k)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, seed: int = 7, fixed_prior: float | None = None) -> Model:
    """Fits a model to a bounded sample: rows labelled toxic, and texts whose labels are not looked at.

    Labels of held-out rows (see held_out) are never read. The sample is the rows of lowest hash,
    at most `positives` and `unlabelled` doc_ids, one text of each, each text once. Features are those of LEAST positive
    texts whose share among them lies APART from that among the unlabelled ones; the driver holds
    the sample's features of these. The class prior is the toxic share of all labelled doc_ids that are not held out, unless fixed_prior is given. A doc_id that any label calls
    toxic is toxic; rows without a toxic value are not labelled. Without toxic labels the model
    knows no features and scores the prior, 0.5 / (labelled rows + 2).
    """
    told = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = told.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.lit(0))).first()
    prior = fixed_prior or min(max((n_toxic or 0.5) / (n + 2), 1e-4), 0.9)
    if not n_toxic:
        return Model(np.empty(0, np.uint64), np.empty(0), float(np.log(prior / (1 - prior))))
    ids = lowest(told.where("toxic = 1").select("doc_id"), n_toxic, positives, seed).withColumn("positive", F.lit(True))
    some = docs.where("doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id")
    n_some = some.agg(F.approx_count_distinct("doc_id", 0.02)).first()[0]
    ids = ids.unionByName(lowest(some.distinct(), n_some, unlabelled, seed).withColumn("positive", F.lit(False)))
    # of rows that repeat a doc_id one text, so that the sample stays within its bounds
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")
    found = found.groupBy("doc_id", "positive").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = written(found.select("positive", "text").distinct(), "sample")
    toxic, rest = sample.where("positive"), sample.where("not positive")
    n_p, n_u = toxic.count(), rest.count()
    top = _counts(toxic, None).where(F.col("n") >= LEAST).orderBy(F.desc("n"), "f").limit(FEATURES).toPandas()
    vocabulary, order_ = np.unique(top["f"].to_numpy(np.int64).view(np.uint64), return_index=True)
    there = _counts(rest, vocabulary).toPandas()
    counts = np.zeros(len(vocabulary))
    counts[there["f"].to_numpy(np.int64)] = there["n"]
    usual = (counts + 1) / (n_u + 2)
    apart = top["n"].to_numpy(float)[order_] / max(n_p, 1) - usual
    vocabulary = vocabulary[np.abs(apart) >= APART * np.sqrt(usual * (1 - usual) / max(n_p, 1))]
    table = _lists(sample, vocabulary).toArrow().combine_chunks()
    lists = table.column("found").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int64()))
    rows = np.repeat(np.arange(table.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    found = lists.flatten().to_numpy(zero_copy_only=False)
    positive = table.column("positive").to_numpy(zero_copy_only=False).astype(bool)
    return Model(vocabulary, *fit_nnpu(rows, found, positive, len(vocabulary), prior))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs, by its whole text.

    A null or empty text has the score of a text without features; a null doc_id is not held out.
    Repeated rows get equal scores; other columns are not read; an empty table gives no rows.
    """
    shared = small_batches(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.score(batch.column("text")))], names=["doc_id", "score"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Rows of docs, with all their columns, whose text scores below the threshold."""
    shared = small_batches(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        at = docs_columns.index("text")
        for batch in batches:
            yield batch.filter(pa.array(own.score(batch.column(at)) < threshold))

    docs_columns = docs.columns
    return docs.mapInArrow(run, docs.schema)
