"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberway.llm._store import written

CYCLE = (1.0, 2.0, 3.0)  #: weights of the sources in their order, repeated
CAP = 3.0  #: a target is at most so many times its source's size
BINS = 4096  #: first steps of the search for the rank at which a source's sample ends


def n_words(text: Column) -> Column:
    """Number of runs of characters outside [\\x20\\x09-\\x0D]; null: 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds rank, from 0, in the order of code points, null last.

    Sources are dealt out by range; each part is numbered by itself and shifted by the sizes of
    the parts before it, of which there are as many as shuffle partitions.
    """
    parts = written(sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()), "sources")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("shift"))
    inside = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1
    return parts.withColumn("inside", inside).join(before, "part").withColumn("rank", F.col("inside") + F.col("shift")).drop("inside", "shift", "part")


def targets(sources: DataFrame, cycle: tuple[float, ...] = CYCLE, cap: float = CAP) -> DataFrame:
    """source, source_size, target: the whole size shared by weight, none above cap times its source's size.

    The excess of a source at its cap is shared again by weight among the rest until none is
    above. Each round is one aggregate; sources capped once stay capped, so rounds are few.
    """
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("rank") % len(cycle) + 1).cast("int"))
    rows = written(ranked(sources).withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap)), "weights")
    size = rows.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        over = F.col("most") <= F.col("weight") * F.lit(level)
        fixed, free = rows.agg(F.sum(F.when(over, F.col("most")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if not free:
            break
        now = (size - fixed) / free
        if now <= level:
            break
        level = now
    return rows.select("source", "source_size", F.least("most", F.col("weight") * F.lit(level)).alias("target"))


def draw(seed: int) -> Column:
    """A number in (0, 1) by doc_id, the whole text and seed."""
    return (F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11) + 0.5) / 2.0**53


def _exact(x: Column) -> Column:
    """A sum of positive numbers by a millionth, the same in whatever order they are added."""
    return (F.sum(F.round(x * 1e6).cast("decimal(38,0)")) / 1e6).cast("double")


def mix(docs: DataFrame, cycle: tuple[float, ...] = CYCLE, cap: float = CAP, seed: int = 17, inclusion: Column | None = None, key: str | None = None) -> DataFrame:
    """doc_id, source, row, size, source_size, target, p, copies, taken: one row per row of docs.

    A source whose target is c times its size first gives floor(c) whole copies of every row.
    The rest of the target is met by one more copy of the rows of lowest Pareto rank,
    (u / (1 - u)) / (p / (1 - p)), as many as come nearest to it in words, and one row more or
    fewer, that whose size is nearest to what is missing still. u is a hash of doc_id, whole text
    and seed, another such hash breaks ties, so reruns agree, whatever the order of the rows. p is a row's odds
    times what makes the expected words of a source's sample its rest; rows for which that is 1 or more are
    certain (p is 1), and the factor is found anew for the others until none is. Odds are `inclusion`, a positive column of docs, where that is
    given, else 2 * size / (size + the source's mean size): longer texts are likelier, fragments
    seldom taken. Rows of a whole-number c get no more. Null texts and blank texts have size 0 and
    take no words. A null source is a source of its own, last in order. No row gives more than
    ceil(cap) copies. Rows of one doc_id and text are alike: how many copies they get together is settled, which of
    them gets one more is not. Texts are read whole, however long, only to be counted and hashed. An empty table gives no rows. row is
    the column key of docs (a number of each row), where that is given; other columns, whatever their names, are not read.
    """
    odds = F.lit(None).cast("double") if inclusion is None else inclusion.cast("double")
    row = F.col(key) if key else F.monotonically_increasing_id()
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), odds.alias("odds"), row.alias("row"), draw(seed).alias("u"), F.xxhash64("text", "doc_id", F.lit(seed + 1)).alias("tie"))
    rows = written(rows, "sized")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("size").alias("mean"))
    goal = targets(sizes.select("source", "source_size"), cycle, cap)
    usual = 2 * F.col("size") / (F.col("size") + F.col("mean"))
    weighed = rows.alias("r").join(sizes.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select(
        "r.source", "mean", (F.coalesce("odds", usual) * F.col("size")).alias("w"))
    weighed = weighed.groupBy("source").agg(_exact(F.col("w")).alias("w"), F.first("mean").alias("mean"))
    goal = goal.alias("g").join(weighed.alias("w"), F.col("g.source").eqNullSafe(F.col("w.source"))).drop(F.col("w.source"))
    goal = goal.withColumn("c", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    goal = goal.withColumn("whole", F.floor("c")).withColumn("part", F.col("c") - F.col("whole")).withColumn("left", F.col("part") * F.col("source_size"))
    goal = written(goal.withColumn("factor", F.when(F.col("w") > 0, F.col("left") / F.col("w"))), "targets")
    odd, n_sure = F.coalesce("odds", usual), 0
    while True:
        r = rows.alias("r").join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).drop(F.col("g.source"))
        sure = odd * F.col("factor") >= 1
        sums = r.where("size > 0").groupBy("source").agg(F.sum(F.when(sure, F.col("size")).otherwise(0)).alias("certain"), _exact(F.when(~sure, odd * F.col("size"))).alias("rest"), F.count(F.when(sure, 1)).alias("n"))
        kept = ("source", "source_size", "target", "w", "mean", "c", "whole", "part", "left")
        factor = F.when(F.col("rest") > 0, (F.col("left") - F.col("certain")) / F.col("rest")).otherwise(F.col("factor"))
        goal = goal.alias("g").join(sums.alias("s"), F.col("g.source").eqNullSafe(F.col("s.source")), "left")
        goal = written(goal.select(*(f"g.{c}" for c in kept), F.when(F.col("s.n") > 0, factor).otherwise(F.col("factor")).alias("factor"), F.col("s.n").alias("sure")), "targets")
        now = goal.agg(F.sum("sure")).first()[0] or 0
        if now == n_sure:  # rows once certain stay so, as the factor only grows
            break
        n_sure = now
    p = F.when(F.col("size") > 0, F.least(odd * F.col("factor"), F.lit(1.0))).otherwise(F.col("part"))
    r = r.withColumn("p", F.when(F.col("w") > 0, p).otherwise(F.lit(0.0)))
    p = F.col("p")
    q = F.when(p > 0, F.col("u") / (1 - F.col("u")) * (1 - p) / p)
    # the rank's own distribution maps it to (0, 1): 1 / (1 + 1 / q) grows with q, so a bin is a range of ranks
    r = r.withColumn("q", q).withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS).cast("int"))
    bins = r.where("q is not null").groupBy("source", "bin").agg(F.sum("size").alias("n"), F.first("left").alias("left"))
    upto = F.sum("n").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    last = bins.withColumn("before", upto - F.col("n")).where("before < left").groupBy("source").agg(F.max(F.struct("bin", "before")).alias("m"))
    last = written(last.select("source", F.col("m.bin").alias("edge"), F.col("m.before").alias("before")), "edges")
    r = r.alias("r").join(last.alias("l"), F.col("r.source").eqNullSafe(F.col("l.source")), "left").drop(F.col("l.source"))
    inside = r.where("q is not null and bin = edge").select("source", "row", "tie", "q", "size", "before", "left")
    run = F.sum("size").over(W.partitionBy("source").orderBy("q", "tie", "row").rowsBetween(W.unboundedPreceding, 0)) + F.col("before")
    chosen = inside.withColumn("run", run).where("run - size < left and run - left <= left - (run - size)").select("row", F.lit(1).alias("more"))
    more = F.when(F.col("bin") < F.col("edge"), 1).otherwise(F.coalesce("more", F.lit(0)))
    drawn = written(r.join(chosen, "row", "left").withColumn("more", F.when(F.col("q").isNotNull(), more).otherwise(0)), "drawn")
    gaps = drawn.where("q is not null").groupBy("source").agg((F.first("left") - F.sum(F.col("more") * F.col("size"))).alias("gap"))
    d = drawn.alias("d").join(gaps.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).drop(F.col("p.source"))
    miss = F.abs(F.abs("gap") - F.col("size"))
    d = d.where("q is not null and size > 0 and more = if(gap > 0, 0, 1)").where(miss < F.abs("gap"))
    last_row = written(d.groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "q", "tie", "row")).alias("m")).select(F.col("m.row").alias("row"), F.lit(1).alias("turn")), "last")
    final = drawn.join(last_row, "row", "left")
    copies = F.col("whole") + F.when(F.col("turn") == 1, 1 - F.col("more")).otherwise(F.col("more"))
    return final.withColumn("copies", copies.cast("long")).select(
        "doc_id", "source", "row", "size", F.col("source_size").cast("long"), "target", "p", "copies", (F.col("copies") * F.col("size")).alias("taken"))
