"""What points within a radius of others come to: pairs meet in blocks of bounded size and are folded there, never stored or shuffled."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberway.functions.geometry import AXES
from emberway.plans.fixpoint import cut, cut_counted

PART = 4_096  #: targets of a cube, about, that a task has at once
BLOCK = 1 << 15  #: pairs that a block has, about
FEW = 100_000  #: cubes whose sizes are broadcast
WAVES = 3  #: tasks a core, so that crowded tiles even out
EMIT = 1 << 20  #: pairs, about, that a task gives at once

_CUBE = [f"tile_{k}" for k in AXES]
_KEY = [*_CUBE, "tile_part", "tile_side"]

Rows = dict[str, np.ndarray]
Fold = Callable[[Rows, Iterator[tuple[Rows, np.ndarray]]], Iterator[Rows]]


class Dealt:
    """Targets (id, x, y, z, ...) dealt into tiles: cubes of side r, those that are crowded in parts."""

    def __init__(self, targets: DataFrame, r: float, part: int = PART):
        self.r, self.columns = r, targets.columns
        own = targets.dropna(subset=list(AXES)).withColumns({f"tile_{k}": F.floor(F.col(k) / r) for k in AXES})
        sizes, counts = cut_counted(own.groupBy(*_CUBE).agg(F.ceil(F.count("*") / part).cast("int").alias("tile_parts")))
        self.sizes = F.broadcast(sizes) if counts["n"] <= FEW else sizes
        own = own.join(self.sizes, _CUBE).withColumns({"tile_part": F.pmod(F.xxhash64(*targets.columns), "tile_parts").cast("int"), "tile_side": F.lit(0)})
        self.rows = cut(own.drop("tile_parts"))


def folded(sources: DataFrame, targets: DataFrame | Dealt, r: float, fold: Fold, schema: str, apart: bool = True, among: DataFrame | None = None) -> DataFrame:
    """Rows of a schema that fold gives for targets (id, x, y, z, ...) and the sources (id, x, y, z, ...) within r of them.

    A target lies in one tile, a source comes to all tiles of the 27 cubes around it. A task goes through its tiles in turn;
    it has a tile's targets and a block of sources at once. fold gets the targets as arrays by column, and blocks (sources, d),
    sources in the order of their ids: d has a row a target, a column a source, and is inf beyond r and, with `apart`, from an
    id to itself. It yields arrays by column. Targets that were dealt are not dealt again; among: only those of some ids (id).
    """
    targets = targets if isinstance(targets, Dealt) else Dealt(cut(targets), r)
    own = targets.rows if among is None else targets.rows.join(among, "id", "left_semi")
    near = sources.dropna(subset=list(AXES))
    for k in AXES:
        at = F.floor(F.col(k) / r)
        near = near.withColumn(f"tile_{k}", F.explode(F.array(at - 1, at, at + 1)))
    near = near.join(targets.sizes, _CUBE).withColumn("tile_part", F.explode(F.sequence(F.lit(0), F.col("tile_parts") - 1))).withColumn("tile_side", F.lit(1))
    rows = own.unionByName(near.drop("tile_parts"), allowMissingColumns=True)
    rows = rows.repartition(WAVES * rows.sparkSession.sparkContext.defaultParallelism, *_KEY[:-1]).sortWithinPartitions(*_KEY, "id")
    names = targets.columns, sources.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, runs in itertools.groupby(_runs(batches), key=lambda x: x[0][:-1]):
            held, first = [], []
            for key, rows in runs:
                if key[-1]:
                    first = [rows]
                    break
                held.append(rows)
            if not held:  # only some targets are asked for
                continue
            own = _arrays(held, names[0])
            near = (_arrays([rows], names[1]) for rows in itertools.chain(first, (rows for _, rows in runs)))
            for out in fold(own, _blocks(own, near, r, apart)):
                if len(next(iter(out.values()))):
                    yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows of one key."""
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in _KEY])
        ends = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for low, high in zip(ends, ends[1:]):
            if high > low:
                yield tuple(keys[:, low]), batch.slice(low, high - low)


def _arrays(batches: list[pa.RecordBatch], names: list[str]) -> Rows:
    rows = pa.Table.from_batches(batches)
    return {n: rows.column(n).to_numpy() for n in names}


def _blocks(own: Rows, near: Iterator[Rows], r: float, apart: bool) -> Iterator[tuple[Rows, np.ndarray]]:
    low, high = {k: own[k].min() for k in AXES}, {k: own[k].max() for k in AXES}
    step = max(1, BLOCK // len(own["x"]))
    for rows in near:
        away = sum(np.maximum(np.maximum(low[k] - rows[k], rows[k] - high[k]), 0.0) ** 2 for k in AXES)
        close = away <= (r * (1 + 1e-9)) ** 2  # what is further from the targets' box is further from each
        rows = {k: v[close] for k, v in rows.items()}
        for at in range(0, int(close.sum()), step):
            some = {k: v[at:at + step] for k, v in rows.items()}
            d = None
            for k in AXES:  # in the order of geometry.distance, so that both give the same bits
                e = own[k][:, None] - some[k]
                e *= e
                d = e if d is None else np.add(d, e, out=d)
            np.sqrt(d, out=d)
            np.copyto(d, np.inf, where=~(d <= r))
            if apart:
                np.copyto(d, np.inf, where=own["id"][:, None] == some["id"])
            yield some, d


def nearest(k: int, kept: Callable | None = None) -> Fold:
    """A fold to src, dst, d: each target's k nearest sources, ties by id; kept: of sources and targets, which may meet."""

    def fold(own: Rows, blocks: Iterator[tuple[Rows, np.ndarray]]) -> Iterator[Rows]:
        ends, best, ids = {n: v[:, None] for n, v in own.items()}, np.full((len(own["id"]), k), np.inf), None
        for near, d in blocks:
            d = d if kept is None else np.where(kept(near, ends), d, np.inf)
            ids = np.full(best.shape, near["id"][0]) if ids is None else ids
            some = np.flatnonzero(d.min(axis=1) < best[:, -1])
            both, names = np.hstack([best[some], d[some]]), np.hstack([ids[some], np.broadcast_to(near["id"], (len(some), d.shape[1]))])
            first = np.argsort(both, axis=1, kind="stable")[:, :k]  # of equal ones those that came first, so of smaller ids
            best[some], ids[some] = np.take_along_axis(both, first, 1), np.take_along_axis(names, first, 1)
        if ids is not None:
            at, rank = np.nonzero(np.isfinite(best))
            yield {"src": own["id"][at], "dst": ids[at, rank], "d": best[at, rank]}

    return fold


def pairs(kept: Callable | None = None, lets: Callable | None = None, told: Callable | None = None, by: tuple[str, ...] = ("d",)) -> Fold:
    """A fold to src, dst, d with src < dst, the pairs themselves, and what told() makes of them.

    kept: of sources and targets, which may meet, as arrays that are broadcast; lets: which pairs stay, told: columns, by the columns
    of the pairs' ends, the latter by length too. They come in the order of some columns, by length if not said, as many as a task has at once: equal values next
    to each other, when rounded, take a small part of the space in Parquet, and the ends, of one tile, are told by short codes.
    """

    def fold(own: Rows, blocks: Iterator[tuple[Rows, np.ndarray]]) -> Iterator[Rows]:
        ends, waiting, n = {k: v[:, None] for k, v in own.items()}, [], 0

        def given():
            rows = {k: np.concatenate([w[k] for w in waiting]) for k in waiting[0]}
            order = np.argsort(rows[by[0]]) if len(by) == 1 else np.lexsort([rows[k] for k in reversed(by)])
            return {k: v[order] for k, v in rows.items()}

        for near, d in blocks:
            arc = np.isfinite(d) & (near["id"] < ends["id"])
            at, of = np.nonzero(arc if kept is None else arc & kept(near, ends))
            if lets is not None:
                left = lets({k: v[of] for k, v in near.items()}, {k: v[at] for k, v in own.items()})
                at, of = at[left], of[left]
            rows = {"src": near["id"][of], "dst": own["id"][at], "d": d[at, of]}
            waiting.append(rows if told is None else rows | told({k: v[of] for k, v in near.items()}, {k: v[at] for k, v in own.items()}, rows["d"]))
            n += len(at)
            if n >= EMIT:
                yield given()
                waiting, n = [], 0
        if n:
            yield given()

    return fold


def least_length(own: Rows, blocks: Iterator[tuple[Rows, np.ndarray]]) -> Iterator[Rows]:
    """A fold to d, the least positive distance of a tile."""
    least = min((d[d > 0].min(initial=np.inf) for _, d in blocks), default=np.inf)
    yield {"d": np.array([least] if np.isfinite(least) else [])}


def least_step(own: Rows, blocks: Iterator[tuple[Rows, np.ndarray]]) -> Iterator[Rows]:
    """A fold to node, step: one more than the least step of what is near."""
    step = np.full(len(own["id"]), np.iinfo(np.int32).max, np.int32)
    for near, d in blocks:
        step = np.minimum(step, np.where(np.isfinite(d), near["step"] + 1, np.iinfo(np.int32).max).min(axis=1))
    some = step < np.iinfo(np.int32).max
    yield {"node": own["id"][some], "step": step[some].astype(np.int32)}


def reached(own: Rows, blocks: Iterator[tuple[Rows, np.ndarray]]) -> Iterator[Rows]:
    """A fold to node: what something is near."""
    met = np.zeros(len(own["id"]), bool)
    for _, d in blocks:
        met |= np.isfinite(d).any(axis=1)
        if met.all():
            break
    yield {"node": own["id"][met]}
