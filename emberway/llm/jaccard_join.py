"""N-gram Jaccard join in its metric space: pivots, Voronoi regions, windows by the triangle inequality.

Steps: cells (a pre-filter: sets that share a rare shingle) name the pivots of the first regions;
regions of bounded size are joined in one task; larger ones are parted by sampled pivots into
Voronoi regions, each with the sets that the triangle inequality cannot keep out, and so on.
Regions that pivots do not part (all sets alike, or all far apart) are joined block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberway.llm._maps import HashSet
from emberway.llm._store import small_batches, written
from emberway.llm._words import Words, blocks, mixed
from emberway.llm.components import components

SHINGLE, NUM, DEN = 5, 80, 100  #: words of a shingle; the least similarity is NUM / DEN
APART = 1 - NUM / DEN + 1e-9  #: distance of linked sets, at most, with a bit for floating point; links are decided in integers
PORTION = 3_000_000  #: shingles that a task counts at a time to find frequent ones
SEEN = 2  #: texts of a portion that make a shingle count there
FREQUENT = (8, 64, 512)  #: texts, of portions where it counts, that make a shingle frequent, and more so
MEMBERS, WEIGHT = 1024, 1_000_000  #: members and shingles of a region that is joined in one piece
PIVOTS = 64  #: pivots of a larger region, at most
PARTED = 0.5  #: share of a region's pairs that its parts may have together, else pivots do not part it
TILE, COLUMNS = 128, 4096  #: sets and shingles that are compared at a time

class Sets:
    """The shingle sets of a block of texts: rows and tokens, sorted by row and token; of each row's set its size and 128 bits (identity, check) that tell it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE):
        words = Words(data, offsets, lower=True)
        h = words.hashes()
        token, at = words.runs(k, h)
        row = np.searchsorted(words.first, at, "right") - 1
        n_words = np.diff(words.first)
        short = np.flatnonzero((n_words > 0) & (n_words < k))
        if len(short):  # the whole sequence is the only shingle
            own = np.zeros(len(short), np.uint64)
            for j in range(k - 1):
                has = n_words[short] > j
                own[has] = mixed(own[has] + h[words.first[short[has]] + j])
            row, token = np.concatenate([row, short]), np.concatenate([token, own])
        order = np.lexsort((token, row))
        row, token = row[order], token[order]
        once = np.ones(len(row), bool)
        once[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
        self.row, self.token = row[once], token[once]
        n = len(offsets) - 1
        self.size = np.bincount(self.row, minlength=n)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.identity, self.check = (self._summed(mixed(self.token ^ np.uint64(x))).view(np.int64) for x in (0, 0x5851F42D4C957F2D))

    def _summed(self, h: np.ndarray) -> np.ndarray:
        """A hash of each row's set."""
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h, out=total[1:])
        return mixed(total[self.start[1:]] - total[self.start[:-1]] + self.size.astype(np.uint64))

def runs_of(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


def needed(size: np.ndarray) -> np.ndarray:
    """Shingles of a set that any linked one must share: the least integer that is NUM / DEN of its size."""
    return -(-size * NUM // DEN)


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def sized(docs: DataFrame, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_shingles, identity, check) of each row, and (token, n) of shingles frequent in a task's portion.

    row is the key, where there is one, else a number of the row, the same in all later jobs.
    """
    schema = "row long, doc_id long, n_shingles long, identity long, check long, token long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            token = np.concatenate(held)
            held.clear()
            token.sort()
            first = runs_of(token)
            n = np.diff(first, append=len(token))
            token, n = token[first[n >= SEEN]], n[n >= SEEN]
            none = pa.nulls(len(token), pa.int64())
            return _batch([none] * 5 + [token.view(np.int64), n.astype(np.int64)], schema)

        for batch in batches:
            for at, data, offsets in blocks(batch.column("text")):
                s = Sets(data, offsets)
                n = len(s.size)
                none = pa.nulls(n, pa.int64())
                own = (batch.column(c).slice(at, n) for c in ("row", "doc_id"))
                yield _batch([*own, s.size.astype(np.int64), s.identity, s.check, none, none], schema)
                held.append(s.token)
                if sum(map(len, held)) > PORTION:
                    yield counted()
        if held:
            yield counted()

    row = F.col(key).cast("long") if key else F.monotonically_increasing_id()
    rows = written(docs.select(row.alias("row"), "doc_id", "text").mapInArrow(run, schema), "sized")
    told = rows.where("n_shingles is not null").select("row", "doc_id", "n_shingles", "identity", "check")
    return told, rows.where("token is not null").select("token", "n")


def prefixes(docs: DataFrame, frequent: list[HashSet], some: HashSet | None = None) -> DataFrame:
    """token, identity, size, at: of each set as many tokens as it can spare and one, in one order of all tokens, the more frequent ones later.

    Two linked sets share a token of these; size is the set's, at the token's place in the order.
    With `some`, only tokens that it holds.
    """
    shared = docs.sparkSession.sparkContext.broadcast((frequent, some))
    schema = "token long, identity long, size int, at int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, some = shared.value
        for batch in batches:
            for _, data, offsets in blocks(batch.column("text")):
                s = Sets(data, offsets)
                order = np.lexsort((s.token, sum(f.holds(s.token).astype(np.int8) for f in frequent), s.row))
                place = np.arange(len(order)) - s.start[s.row]
                spare = s.size - needed(s.size) + 1
                fresh = np.zeros(len(s.size), bool)
                fresh[np.unique(np.stack([s.identity, s.check]), axis=1, return_index=True)[1]] = True
                take = np.flatnonzero((place < spare[s.row]) & fresh[s.row])
                token = s.token[order[take]]
                if some is not None:
                    there = some.holds(token)
                    take, token = take[there], token[there]
                own = s.row[take]
                yield _batch([token.view(np.int64), s.identity[own], s.size[own].astype(np.int32), place[take].astype(np.int32)], schema)

    return docs.select("text").mapInArrow(run, schema)


def cells(docs: DataFrame, frequent: list[HashSet]) -> DataFrame:
    """region, identity: the sets that could be linked with another one by way of a token, by the pivot of its cell; two a region at least.

    A pre-filter. A token's sets are cut where sizes, in order, part by more than linked sets' may.
    Of a cut's sets those cannot be linked by way of this token as the first one they share whose
    shingles from there on are too few for the smallest set in reach. The cut's pivot is, of the
    others, that of least identity, a random one; its region is that of all cuts that it is pivot of.

    Linked sets of sizes n and m share, of both prefixes, all of their ceil((n + m) * NUM / (NUM + DEN))
    shingles but those that the longer of the two rests can hold. A set goes from a region if all
    its tokens that any other set has are fewer than that for the sizes in reach at either end.

    All is by aggregates and joins: a token that very many sets have is summed up by size, and its
    rows may be split among tasks.
    """
    spread = F.min("identity").alias("lo"), F.max("identity").alias("hi")
    several = prefixes(docs, frequent).groupBy("token").agg(*spread).where("lo <> hi").select("token")
    several = written(several, "tokens")
    rows = written(prefixes(docs, frequent, HashSet(several, "token", several.count())), "prefixes")

    by_size = W.partitionBy("token").orderBy("size")
    apart = DEN * F.lag("size").over(by_size) < NUM * F.col("size")
    cuts = rows.groupBy("token", "size").agg(*spread)
    cuts = cuts.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int"))
    cuts = cuts.withColumn("cut", F.sum("apart").over(by_size.rowsBetween(W.unboundedPreceding, 0)))
    cut = W.partitionBy("token", "cut")
    ends = {"lo": F.min("lo"), "hi": F.max("hi"), "least": F.min("size"), "most": F.max("size")}
    cuts = cuts.withColumns({c: f.over(cut) for c, f in ends.items()}).where("lo <> hi")

    n = F.col("size")
    reach = lambda m: F.ceil((n + m) * NUM / (NUM + DEN))
    spared = lambda m: F.ceil(m * NUM / DEN)
    low, high = F.greatest("least", spared(n)), F.least("most", F.floor(n * DEN / NUM))
    common = F.least(reach(low) - F.greatest(spared(n), spared(low)), reach(high) - F.greatest(spared(n), spared(high)))
    rows = rows.join(cuts.select("token", "size", "cut", "least", "most"), ["token", "size"])
    rows = written(rows.select("token", "cut", "identity", common.alias("common"), (n - F.col("at") >= reach(low)).alias("able")), "cells")
    pivot = rows.where("able").groupBy("token", "cut").agg(F.min("identity").alias("region"))
    named = rows.join(pivot, ["token", "cut"], "left").withColumn("region", F.when(F.col("able"), F.col("region")))
    each = written(named.groupBy("region", "identity").agg(F.count("*").alias("shared"), F.min("common").alias("common")), "shared")
    every = each.groupBy("identity").agg(F.sum("shared").alias("every"))
    kept = each.where("region is not null").join(every, "identity").where("common <= every").select("region", "identity")
    return kept.join(kept.groupBy("region").agg(F.count("*").alias("n")).where("n > 1").select("region"), "region")


def texts_of(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """identity, check, text: a text of each set in members, and of a few others."""
    shared = docs.sparkSession.sparkContext.broadcast(HashSet(members, "identity", n))
    schema = "identity long, check long, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in blocks(batch.column("text")):
                s = Sets(data, offsets)
                own, first = np.unique(np.stack([s.identity, s.check]), axis=1, return_index=True)
                some = np.sort(first[shared.value.holds(np.ascontiguousarray(own[0]))])
                yield _batch([s.identity[some], s.check[some], batch.column("text").take(pa.array(some + at))], schema)

    return docs.select("text").mapInArrow(run, schema).groupBy("identity", "check").agg(F.first("text").alias("text"))


def in_common(values: np.ndarray, member: np.ndarray, n: int, tiles: list[tuple[slice, slice]]) -> np.ndarray:
    """How many values each two of n members have in common, for the members of each tile's rows and columns.

    Values that the same members have are one column, as often as there are such; products of
    the columns' matrix count them, a few columns at a time.
    """
    order = np.argsort(values, kind="stable")
    member, first = member[order], runs_of(values[order])
    count = np.diff(first, append=len(values))
    kind = np.add.reduceat(mixed(np.arange(1, n + 1, dtype=np.uint64))[member], first) if len(first) else np.empty(0, np.uint64)
    some = np.flatnonzero(count > 1)
    _, one, often = np.unique(kind[some], return_index=True, return_counts=True)
    exact = np.float32 if len(values) < 1 << 24 else np.float64
    out = np.zeros((n, n), exact)
    for at in range(0, len(one), COLUMNS):
        own = some[one[at : at + COLUMNS]]
        column = np.repeat(np.arange(len(own)), count[own])
        place = np.arange(len(column)) - np.repeat(np.cumsum(count[own]) - count[own], count[own]) + np.repeat(first[own], count[own])
        has = np.zeros((n, len(own)), exact)
        has[member[place], column] = 1
        times = has * often[at : at + COLUMNS].astype(exact)
        for a, b in tiles:
            out[a, b] += has[a] @ times[b].T
    return out


class Region:
    """The sets of a region's texts."""

    def __init__(self, texts: pa.Array):
        found = [(s.token, s.size) for _, data, offsets in blocks(texts) for s in [Sets(data, offsets)]]
        self.tokens, self.size = (np.concatenate(x) for x in zip(*found))
        self.member = np.repeat(np.arange(len(self.size)), self.size)

    def distances(self, k: int) -> np.ndarray:
        """Of each set to each of the first k."""
        both = in_common(self.tokens, self.member, len(self.size), [(slice(0, k), slice(None))])[:k].T.astype(np.int64)
        np.fill_diagonal(both, self.size[:k])
        return 1 - both / (self.size[:, None] + self.size[:k] - both)

    def linked(self) -> np.ndarray:
        """Which two sets are linked. In the order of distances to the first set, only those are

        compared whose distances differ by no more than a link's: the others cannot be linked.
        """
        n, far = len(self.size), self.distances(1)[:, 0]
        order = np.argsort(far, kind="stable")
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        far, size = far[order], self.size[order]
        tiles = []
        for at in range(0, n, TILE):
            rows = slice(at, min(at + TILE, n))
            lo, hi = np.searchsorted(far, [far[at] - APART, far[rows.stop - 1] + APART], "left")
            tiles.append((rows, slice(lo, hi)))
        both = in_common(self.tokens, back[self.member], n, tiles)
        return (DEN * both >= NUM * (size[:, None] + size - both))[back][:, back]


PAIR = "region long, part long, pivot int, block int, root long, identity long, check long, node long, core boolean, size long, copies long, homes array<long>"
FOUND = "a long, b long, n long"


def _grouped(rows: DataFrame, texts: DataFrame, work: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """work on the rows of each (region, part), with their texts, pivots first; they come to one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column("region").to_numpy(), batch.column("part").to_numpy()], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for i, j in zip(cuts, cuts[1:]):
                if now is not None and tuple(key[i]) != now:
                    yield work(pa.Table.from_batches(held).combine_chunks())
                    held.clear()
                now = tuple(key[i])
                held.append(batch.slice(i, j - i))
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    names = [x.split()[0] for x in PAIR.split(", ")]
    full = rows.join(texts, ["identity", "check"]).select(*names, "text").repartition("region", "part")
    return full.sortWithinPartitions("region", "part", F.desc("pivot"), "node").mapInArrow(run, schema)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _text(table: pa.Table) -> pa.Array:
    return pa.concat_arrays(table.column("text").chunks)


def find_links(table: pa.Table) -> pa.RecordBatch:
    """Rows of FOUND for the sets of a region: (a, null, n), n rows linked with core set a; (a, b, 0), links enough to connect the linked.

    Sets that meet in several first regions count as linked in the least of these alone. Of two
    blocks (of number 0 or more) only sets of different ones count.
    """
    n, root = table.num_rows, _column(table, "root")[0]
    if n < 2:
        return _batch([pa.nulls(0, pa.int64())] * 3, FOUND)
    near = Region(_text(table)).linked()
    lists = pa.concat_arrays(table.column("homes").chunks)
    homes, whose = lists.flatten().to_numpy(), np.repeat(np.arange(n), lists.value_lengths().to_numpy())
    some = homes < root
    if some.any():
        near &= in_common(homes[some], whose[some], n, [(slice(None), slice(None))]) == 0
    block, node, core = _column(table, "block"), _column(table, "node"), table.column("core").to_numpy()
    if block[0] >= 0:
        near &= block[:, None] != block
    np.fill_diagonal(near, False)
    count = near @ _column(table, "copies")
    label, links = np.arange(n), []
    for i in range(n):
        others = np.flatnonzero(near[i] & (label != label[i]))
        for j in others[np.unique(label[others], return_index=True)[1]]:
            links.append((node[i], node[j]))
            label[label == label[j]] = label[i]
    own = np.flatnonzero(core & (count > 0))
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    columns = [
        np.concatenate([node[own], a]),
        pa.array(np.concatenate([node[own], b]), mask=np.arange(len(own) + len(a)) < len(own)),
        np.concatenate([count[own], np.zeros(len(a), np.int64)]),
    ]
    return _batch(columns, FOUND)


def assign(table: pa.Table) -> pa.RecordBatch:
    """A region's sets by the pivots before them.

    A set within two links' distances of a pivot goes to the Voronoi region of its nearest one as
    a core set, if it was one. Others are core sets of a region of their own, the rest. What is
    linked with a core set goes there too, in the windows that the triangle inequality leaves:
    regions whose pivot is at most two links' distances further away than the nearest one, and
    three away at most; the rest, if the nearest is more than one away.
    """
    k = int(_column(table, "pivot").sum())
    far = Region(_text(table)).distances(k)[k:]
    near = far.min(1)[:, None]
    home = np.where(near[:, 0] <= 2 * APART, far.argmin(1), k)
    window = (far - near <= 2 * APART) & (far <= 3 * APART)
    own, pivot = np.nonzero(np.concatenate([window, near > APART], 1))
    table, names = table.slice(k), [x.split()[0] for x in PAIR.split(", ")]
    rows = table.select(names).take(pa.array(own)).combine_chunks()
    child = mixed(rows.column("region").to_numpy().view(np.uint64) + mixed(pivot.astype(np.uint64) + np.uint64(1))).view(np.int64)
    core = rows.column("core").to_numpy() & (pivot == home[own])
    columns = {c: pa.concat_arrays(rows.column(c).chunks) if len(own) else pa.array([], rows.schema.field(c).type) for c in names}
    columns |= {"part": columns["region"], "region": pa.array(child), "core": pa.array(core)}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=names)


def _parts(n: int, weight: int):
    """Parts of bounded size that a region of n sets and w shingles is dealt into."""
    return F.greatest(F.lit(1), F.ceil(F.greatest(F.col("n") / n, F.col("w") / weight))).cast("int")


def part_by_pivots(rows: DataFrame, texts: DataFrame, members: int, weight: int, pivots: int) -> DataFrame:
    """Rows (PAIR, n, w) of regions by their Voronoi regions; part is the region they come from.

    Pivots are sets of least hash, a sample; they meet the sets in parts of bounded size.
    """
    k = F.least(F.lit(pivots), F.greatest(F.lit(2), F.floor(F.lit(weight) * F.col("n") / F.col("w")))).cast("int")
    draw = F.xxhash64("node", "region")
    some = rows.where(F.abs(draw / 2.0**63) * F.col("n") <= F.greatest(F.lit(64), 4 * k))  # bounded by region
    few = some.groupBy("region").agg(F.slice(F.array_sort(F.collect_list(F.struct(draw.alias("draw"), "node"))), 1, F.first(k)).alias("few"))
    chosen = few.select("region", F.explode("few.node").alias("node"))
    parts = _parts(members, weight)
    as_pivot = rows.join(chosen, ["region", "node"]).withColumn("pivot", F.lit(1)).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    as_member = rows.withColumn("part", F.pmod(draw, parts)).join(chosen.select("region").distinct(), "region", "left_semi")
    both = as_pivot.withColumn("part", F.col("part").cast("long")).unionByName(as_member.withColumn("part", F.col("part").cast("long")))
    return _grouped(both, texts, assign, PAIR)


def in_blocks(rows: DataFrame, members: int, weight: int) -> DataFrame:
    """Rows (PAIR, n, w) of regions dealt into blocks, every two of which meet in a part."""
    count = _parts(max(1, members // 2), max(1, weight // 2))
    rows = rows.withColumn("blocks", count).withColumn("block", F.pmod(F.xxhash64("node"), count).cast("int"))
    # block i meets every block j, itself among them, in part (least, greatest)
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("one"), F.greatest("block", j).alias("two")))
    met = rows.withColumn("met", F.explode(others))
    inside = F.col("met.one") == F.col("met.two")
    met = met.withColumn("part", (F.col("met.one") * F.lit(1 << 31) + F.col("met.two")).cast("long"))
    return met.withColumn("block", F.when(inside, F.lit(-1)).otherwise(F.col("block"))).drop("met", "blocks")


def found_in(pairs: DataFrame, texts: DataFrame, members: int = MEMBERS, weight: int = WEIGHT, pivots: int = PIVOTS, report: list | None = None) -> DataFrame:
    """FOUND for first regions (root, identity, check, node, size, copies, homes); report gets (large, parted, replicas) of each level."""
    rows = pairs.select(F.col("root").alias("region"), F.lit(0).cast("long").alias("part"), F.lit(0).alias("pivot"), F.lit(-1).alias("block"), "root", "identity", "check", "node", F.lit(True).alias("core"), "size", "copies", "homes")
    found = []
    while True:
        each = rows.groupBy("region").agg(F.count("*").alias("n"), F.sum("size").alias("w"), F.sum(F.col("core").cast("long")).alias("cores")).where("cores > 0")
        large = written(each.where((F.col("n") > members) | (F.col("w") > weight)), "large")
        n_large = large.count()
        if not n_large:
            found.append(written(_grouped(rows, texts, find_links, FOUND), "found"))
            break
        texts = written(texts, "texts") if not found else texts
        small = rows.join(large.select("region"), "region", "left_anti")
        found.append(written(_grouped(small, texts, find_links, FOUND), "found"))
        rows = rows.join(large, "region")
        children = written(part_by_pivots(rows, texts, members, weight, pivots), "parted")
        sizes = children.groupBy("part", "region").agg(F.count("*").alias("n"), F.sum(F.col("core").cast("long")).alias("cores")).where("cores > 0")
        work = sizes.groupBy("part").agg(F.sum(F.col("n") * F.col("cores")).alias("work")).withColumnRenamed("part", "region")
        parted = written(large.join(work, "region").where(F.col("work") <= PARTED * F.col("n") * F.col("cores")).select("region"), "progress")
        if report is not None:
            report.append((n_large, parted.count(), sizes.agg(F.sum("n")).first()[0]))
        flat = in_blocks(rows.join(parted, "region", "left_anti"), members, weight)
        found.append(written(_grouped(flat, texts, find_links, FOUND), "found"))
        rows = children.join(parted.withColumnRenamed("region", "part"), "part", "left_semi")
        rows = rows.join(sizes.select("part", "region"), ["part", "region"], "left_semi").withColumn("part", F.lit(0).cast("long"))
        rows = written(rows.withColumn("pivot", F.lit(0)).select(*[x.split()[0] for x in PAIR.split(", ")]), "regions")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def near_duplicates(docs: DataFrame, members: int = MEMBERS, weight: int = WEIGHT, pivots: int = PIVOTS, key: str | None = None, report: list | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: one row per row of docs.

    Words are [^\\x20\\x09-\\x0D]+ of the text with A-Z in lower case; a set holds the text's distinct
    5-word shingles, or the whole sequence if that is shorter. Null and blank texts have empty sets
    and are linked with nothing. Two texts are linked at 100 * intersection >= 80 * union;
    component_id is the smallest doc_id that links lead to (null only if all are null), n_links the
    number of other rows that a row is linked with. Rows of one set are one node, so copies cost
    nothing; rows that repeat a doc_id are nodes by their own text. An empty table gives no rows.
    Shingles are told by 64-bit hashes, sets by 128 bits.

    Two linked sets share a token of their prefixes, hence a cell, whose pivot's region has both.
    In a region that is too large for one task each set becomes a core set of its nearest pivot's
    region; a set linked with it is at most two links' distances further from that pivot than
    from its own, so the regions' windows lose no link, and a core set finds all its links there.
    The number of links takes comparing all pairs within windows, which in a group of texts that
    are all alike is the square of its distinct texts, in blocks of bounded size.

    With key, a column of whole numbers, each once, it is returned too, and kept: of the rows that
    links connect that of the smallest doc_id (null last), then of the smallest key. Rows with
    empty sets are all kept. Equal component_ids need not be one component where doc_ids repeat.
    """
    small_batches(docs.sparkSession)
    rows, frequent = sized(docs, key)
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row") if key else F.struct(F.col("doc_id").isNull().alias("late"), "doc_id")
    sets = rows.where("n_shingles > 0").groupBy("identity", "check").agg(F.min("row").alias("node"), F.max("n_shingles").alias("size"), F.count("*").alias("copies"), F.min(order).alias("least"))
    sets = written(sets, "sets")
    common = written(frequent.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT[0]), "frequent")
    levels = [common.where(F.col("n") >= n) for n in FREQUENT]
    pairs = cells(docs, [HashSet(c, "token", c.count()) for c in levels]).withColumnRenamed("region", "root")
    pairs = written(pairs.join(sets.drop("least"), "identity"), "members")
    homes = pairs.groupBy("node").agg(F.collect_list("root").alias("homes"))
    texts = texts_of(docs, pairs, pairs.agg(F.approx_count_distinct("node")).first()[0])
    found = found_in(pairs.join(homes, "node"), texts, members, weight, pivots, report)
    names = components(found.where("b is not null").select("a", "b"))
    linked = found.where("b is null").groupBy("a").agg(F.sum("n").alias("linked"))
    named = sets.join(names, "node", "left").join(linked, F.col("node") == F.col("a"), "left")
    named = written(named.select("identity", "check", "copies", "least", F.coalesce("label", "node").alias("label"), F.coalesce("linked", F.lit(0)).alias("linked")), "named")
    first = named.groupBy("label").agg(F.min("least").alias("first"))
    final = named.join(first, "label").select("identity", "check", "first", (F.col("linked") + F.col("copies") - 1).alias("n_links"))
    full = rows.where("n_shingles > 0").join(final, ["identity", "check"])
    full = full.select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), "n_links", *([F.col("row").alias(key), (F.col("row") == F.col("first.row")).alias("kept")] if key else []))
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), *([F.col("row").alias(key), F.lit(True).alias("kept")] if key else []))
    return full.unionByName(empty)
