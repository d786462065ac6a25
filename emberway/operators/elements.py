"""Finding floors and stairs among a building's products, and the lines that join them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from emberway.operators.order import numbered, since, union
from emberway.plans.fixpoint import cut, cut_counted

MIN_AREA, TILT, MAX_SPAN = 9.0, 0.3, 1.0  #: of a floor: least box area, least mean |nz|, greatest height unless flat
# Bounds of a tread and of a stair made of treads.
TREAD = {"nz": 0.95, "min_area": 0.25, "max_area": 3.0, "max_width": 1.8}
STAIR = {"min_rise": 0.12, "max_rise": 0.22, "overlap": 0.25, "treads": 4, "total_rise": 0.6, "spread": 0.04}


def distinct_vertices(corners: DataFrame, digits: int = 6) -> DataFrame:
    """uid, x, y, z: corners (ordinal, x, y, z) that agree to some digits are one vertex, with the first one's coordinates and the number of its first appearance."""
    keys = [F.round(k, digits).alias(f"k{k}") for k in "xyz"]
    first = corners.groupBy(*keys).agg(F.min(F.struct("ordinal", "x", "y", "z")).alias("f")).select("f.*")
    return numbered(first, ["ordinal"], "n").select(F.concat(F.lit("v"), F.col("n").cast("string")).alias("uid"), "x", "y", "z")


def hint(word: str, *names: str) -> Column:
    """Whether one of the columns contains a word, in any case."""
    found = F.lit(False)
    for n in names:
        found = found | F.contains(F.upper(F.coalesce(F.col(n), F.lit(""))), F.lit(word.upper()))
    return found


def product_boxes(tri: DataFrame) -> DataFrame:
    """Per product (geom_id) of measured triangles: minx to maxz, spans, box area and mean |nz|."""
    out = tri.groupBy("geom_id").agg(
        *(F.min(F.least(f"a{k}", f"b{k}", f"c{k}")).alias(f"min{k}") for k in "xyz"),
        *(F.max(F.greatest(f"a{k}", f"b{k}", f"c{k}")).alias(f"max{k}") for k in "xyz"),
        F.coalesce(F.avg(F.abs("uz")), F.lit(1.0)).alias("mean_nz"))
    out = out.select("*", *((F.col(f"max{k}") - F.col(f"min{k}")).alias(f"span{k}") for k in "xyz"))
    return out.withColumn("box_area", F.col("spanx") * F.col("spany"))


def like_stair() -> Column:
    """The shape of a stair: a storey high, tilted on the whole, steep for its length."""
    wide = F.greatest("spanx", "spany")
    return F.col("spanz").between(1, 4) & (wide >= 1) & F.col("mean_nz").between(0.2, 0.8) & (F.col("spanz") / wide >= 0.2)


def like_floor(min_area: float = MIN_AREA, tilt: float = TILT, max_span: float = MAX_SPAN) -> Column:
    return (F.col("box_area") >= min_area) & ((F.col("mean_nz") >= tilt) | (F.col("spanz") <= max_span))


def footprint(tri: DataFrame) -> DataFrame:
    """geom_id, x, y: the distinct corners of a product seen from above, to 4 digits."""
    corners = F.explode(F.array(*(F.struct(F.round(f"{p}x", 4).alias("x"), F.round(f"{p}y", 4).alias("y")) for p in "abc")))
    return tri.select("geom_id", corners.alias("c")).select("geom_id", "c.x", "c.y").distinct()


def treads(tri: DataFrame) -> DataFrame:
    """model, tread, minx, maxx, miny, maxy, z of measured triangles that are flat, of a tread's area and not too wide."""
    box = [f(f"a{k}", f"b{k}", f"c{k}").alias(f"{n}{k}") for k in "xy" for n, f in (("min", F.least), ("max", F.greatest))]
    rows = tri.select("model", F.concat_ws(":", "geom_id", "tri_no").alias("tread"), "uz", "area", *box, ((F.col("az") + F.col("bz") + F.col("cz")) / 3).alias("z"))
    wide = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    fits = (F.abs("uz") >= TREAD["nz"]) & F.col("area").between(TREAD["min_area"], TREAD["max_area"]) & (wide <= TREAD["max_width"])
    return rows.where(fits).select("model", "tread", "minx", "maxx", "miny", "maxy", "z")


def risers(treads: DataFrame) -> DataFrame:
    """p, s, rise: pairs of numbered treads (n, model, minx, ..., z) of a model, the second a riser's height above the first and overlapping it on both axes.

    Pairs meet by bands of height and by cells that both cover; a pair counts in the cell of its overlap's low corner.
    """
    band, cell = 1.01 * STAIR["max_rise"], TREAD["max_width"]
    covered = lambda k: F.sequence(F.floor(F.col(f"min{k}") / cell), F.floor(F.col(f"max{k}") / cell))
    spread = treads.withColumn("band", F.floor(F.col("z") / band)).withColumn("cx", F.explode(covered("x"))).withColumn("cy", F.explode(covered("y")))
    low = spread.withColumn("band", F.explode(F.array("band", F.col("band") + 1))).select("model", "band", "cx", "cy", *(F.col(c).alias("p_" + c) for c in ("n", "minx", "maxx", "miny", "maxy", "z")))
    met = low.join(spread, ["model", "band", "cx", "cy"])
    rise = F.col("z") - F.col("p_z")
    fits = rise.between(STAIR["min_rise"], STAIR["max_rise"])
    for k in "xy":
        start = F.greatest(f"p_min{k}", f"min{k}")
        fits = fits & (F.least(f"p_max{k}", f"max{k}") - start >= STAIR["overlap"]) & (F.floor(start / cell) == F.col(f"c{k}"))
    return met.where(fits).select(F.col("p_n").alias("p"), F.col("n").alias("s"), rise.alias("rise"))


def chained(arcs: DataFrame, rounds: int = 10_000) -> DataFrame:
    """s, p, rise, base: which arcs (p, s, rise) greedy chains take, where treads are numbered from below and every chain's first tread is its base.

    One by one from below, each tread that no chain has taken would begin a chain, which goes on with the least rise (of
    equal ones the smallest s) to a tread not taken yet. Here all chains grow at once: an end whose best
    tread is wanted by no chain with a smaller base, nor by a tread of which it is not yet known whether and
    by which chain it is taken, can have it, whatever the others do. As the chain with the smallest base always goes first,
    the result is that of taking turns. Each round grows every chain that can by a tread.
    """
    took = arcs.select("s", "p", "rise", F.col("p").alias("base")).limit(0)
    parts: list[DataFrame] = []
    alive, counts = cut_counted(arcs)
    for _ in range(rounds):
        if not counts["n"]:
            return union([took, *parts])
        if len(parts) >= 6:
            took, parts = cut(union([took, *parts])), []
        known = union([took, *parts]).select(F.col("s").alias("p"), "base")
        wanted = alive.select(F.col("s").alias("p")).distinct().withColumn("wanted", F.lit(True))
        ends = alive.select("p").distinct().join(known, "p", "left").join(wanted, "p", "left")
        # a tread that is not taken and wanted by none begins a chain; one still wanted could come from any
        ends = ends.select("p", F.when(F.col("base").isNotNull(), F.col("base")).when(F.col("wanted").isNull(), F.col("p")).otherwise(-1).alias("base"))
        first, best = F.min("base").over(W.partitionBy("s")), F.min(F.struct("rise", "s")).over(W.partitionBy("p"))
        met = alive.join(ends, "p").withColumn("first", first).withColumn("best", best["s"])
        new = cut(met.where("base >= 0 and base = first and s = best").select("s", "p", "rise", "base"))
        parts.append(new)
        alive, counts = cut_counted(alive.join(new.select("p"), "p", "left_anti").join(new.select("s"), "s", "left_anti").select("p", "s", "rise"))
    raise ValueError(f"chains still grow after {rounds} rounds")


def stair_chains(candidates: DataFrame) -> DataFrame:
    """model, stair, n, minx, maxx, miny, maxy, z_min, z_max: chains of treads that rise like a stair.

    Going up by z (ties by tread), a free tread begins a chain; it goes on with the next free one
    that rises by a riser's height over the last and overlaps it on both axes. A chain of enough
    treads, rise and even risers is a stair; treads of a chain are used up, also where it is none.
    Stairs of a model are numbered from below. Pairs of treads are found by a join and chains by rounds (see
    chained), so that no task has a model.
    """
    treads = cut(numbered(candidates, ["model", "z", "tread"], "n"))
    took = cut(chained(risers(treads)))
    each = treads.join(took.select(F.col("s").alias("n"), "base", "rise"), "n", "left").withColumn("base", F.coalesce("base", "n"))
    box = [f(f"{n}{k}").alias(f"{n}{k}") for k in "xy" for n, f in (("min", F.min), ("max", F.max))]
    chains = each.groupBy("model", "base").agg(F.count("*").alias("n"), *box, F.min("z").alias("z_min"), F.max("z").alias("z_max"), (F.max("rise") - F.min("rise")).alias("spread"))
    stairs = chains.where((F.col("n") >= STAIR["treads"]) & (F.col("z_max") - F.col("z_min") >= STAIR["total_rise"]) & (F.col("spread") <= STAIR["spread"]))
    number = F.row_number().over(W.partitionBy("model").orderBy("base")) - 1
    return stairs.select("model", number.cast("long").alias("stair"), "n", "minx", "maxx", "miny", "maxy", "z_min", "z_max")


def with_hints(shaped: DataFrame, named_floors: DataFrame, named_stairs: DataFrame) -> DataFrame:
    """Boxes to go on with: if any floor is named as such, the named floors stand for all that shapes gave, stairs too; named stairs are added in any case."""
    any_named = named_floors.agg((F.count("*") > 0).alias("named"))
    kept = shaped.crossJoin(F.broadcast(any_named)).where("not named").drop("named")
    return kept.unionByName(named_floors).unionByName(named_stairs)


def merged_levels(boxes: DataFrame, reach: float = 1.5) -> DataFrame:
    """model, level, is_stair, z, n and the joint bounds: boxes (model, box, is_stair, z, minx, maxx, miny, maxy, z_min, z_max) folded by height.

    Going up by z (ties by box), a box joins the last level if it is of the same kind and within
    reach of the level's mean z, else it begins one. z_min and z_max, where missing, are z.

    A box of another kind than the one below, or further than reach above it, begins a level whatever came before, as no
    mean is above its last box. Rows numbered by range are cut there, and the pieces are folded apart, each as a
    stream of rows of which only the level in hand is held.
    """
    boxes = boxes.withColumns({c: F.col("z") for c in ("z_min", "z_max") if c not in boxes.columns})
    rows = cut(numbered(boxes, ["model", "z", "box"], "at"))
    below = rows.select((F.col("at") + 1).alias("at"), F.col("model").alias("model_below"), F.col("is_stair").alias("kind_below"), F.col("z").alias("z_below"))
    begins = F.col("model_below").isNull() | (F.col("model") != F.col("model_below")) | (F.col("is_stair") != F.col("kind_below")) | (F.col("z") - F.col("z_below") > reach)
    pieces = since(rows.join(below, "at", "left"), "at", begins, "piece")
    names = ["model", "at", "is_stair", "z", "minx", "maxx", "miny", "maxy", "z_min", "z_max"]
    kinds = dict(rows.dtypes)
    schema = f"model {kinds['model']}, at bigint, is_stair boolean, z double, n bigint, minx double, maxx double, miny double, maxy double, z_min double, z_max double"
    sides = [min, max, min, max, min, max]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, level = None, None  # model, at, is_stair, z, n and six bounds
        for batch in batches:
            done = []
            for own, model, at, kind, z, *bounds in zip(*(batch.column(c).to_pylist() for c in ("piece", *names))):
                if level is not None and own == piece and abs(z - level[3]) <= reach:
                    level[3], level[4] = (level[3] * level[4] + z) / (level[4] + 1), level[4] + 1
                    level[5:] = [f(x, y) for f, x, y in zip(sides, level[5:], bounds)]
                else:
                    if level is not None:
                        done.append(level)
                    piece, level = own, [model, at, kind, z, 1, *bounds]
            yield told(done)
        if level is not None:
            yield told([level])

    def told(levels: list) -> pa.RecordBatch:
        columns = list(zip(*levels)) or [()] * 11
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names=["model", "at", "is_stair", "z", "n", *names[4:]])

    types = [to_arrow_type(rows.schema["model"].dataType), pa.int64(), pa.bool_(), pa.float64(), pa.int64(), *[pa.float64()] * 6]
    doubles = [F.col(c).cast("double").alias(c) for c in names[3:]]
    levels = cut(pieces.select("piece", *names[:3], *doubles).repartition("piece").sortWithinPartitions("piece", "at").mapInArrow(fold, schema))
    ranked = cut(numbered(levels, ["at"], "rank"))
    first = ranked.groupBy("model").agg(F.min("rank").alias("first"))
    return ranked.join(first, "model").select("model", (F.col("rank") - F.col("first")).cast("int").alias("level"), "z", "n", "is_stair", *names[4:])


def medial_axis(points: DataFrame, by: str = "model") -> DataFrame:
    """by, sx, sy, sz, ex, ey, ez: the span of footprint points (x, y, z) along their principal direction, 0.1 above their mean z.

    Moments are those of the population. A direction that cannot be told is (1, 0).
    """
    m = points.groupBy(by).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"))
    half = (F.col("xx") + F.col("yy")) / 2
    top = half + F.sqrt(F.greatest(half * half - (F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")), F.lit(0.0)))
    m = m.withColumn("vx", F.col("xy")).withColumn("vy", top - F.col("xx"))
    size = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    m = m.withColumn("size", size).withColumn("dx", F.when(F.col("size") > 1e-12, F.col("vx") / F.col("size")).otherwise(1.0)).withColumn("dy", F.when(F.col("size") > 1e-12, F.col("vy") / F.col("size")).otherwise(0.0))
    along = (F.col("x") - F.col("mx")) * F.col("dx") + (F.col("y") - F.col("my")) * F.col("dy")
    span = points.drop("z").join(m, by).groupBy(by, "mx", "my", "mz", "dx", "dy").agg(F.min(along).alias("lo"), F.max(along).alias("hi"))
    end = lambda t, p: [(F.col("mx") + F.col(t) * F.col("dx")).alias(f"{p}x"), (F.col("my") + F.col(t) * F.col("dy")).alias(f"{p}y"), (F.col("mz") + 0.1).alias(f"{p}z")]
    return span.select(by, *end("lo", "s"), *end("hi", "e"))


def floors_or_all(levels: DataFrame) -> DataFrame:
    """Levels that are no stairs; all, in a model that has only stairs."""
    has = levels.where("not is_stair").select(F.col("model").alias("m")).distinct()
    marked = levels.join(has, levels["model"] == has["m"], "left")
    return marked.where("not is_stair or m is null").drop("m")


def stair_connectors(stairs: DataFrame) -> DataFrame:
    """id, kind and the ends of a line from just above a stair's foot to just below its head, at its centre."""
    cx, cy = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    return stairs.select("id", F.lit("stair").alias("kind"), cx.alias("ax"), cy.alias("ay"), (F.col("z_min") + 0.05).alias("az"), cx.alias("bx"), cy.alias("by"), (F.col("z_max") - 0.05).alias("bz"))


def grid_wires(boxes: DataFrame) -> DataFrame:
    """id, kind, line and the ends of lines across a box, both ways; the last may lie beyond its edge.

    Their distance is a twelfth of the box's lesser side (a sixth for a stair), 0.75 (0.5) at
    least; there are int(side / distance) + 1 gaps, 2 at least. A stair has its diagonal too.
    """
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    step = F.greatest(F.least(w, h) / F.when(F.col("is_stair"), 6).otherwise(12), F.when(F.col("is_stair"), 0.5).otherwise(0.75))
    b = boxes.withColumn("step", step)
    n = lambda side: F.greatest(F.lit(2), F.floor(side / F.col("step")).cast("int") + 1)
    across = b.withColumn("line", F.explode(F.sequence(F.lit(0), n(w)))).withColumn("p", F.col("minx") + F.col("line") * F.col("step"))
    along = b.withColumn("line", F.explode(F.sequence(F.lit(0), n(h)))).withColumn("p", F.col("miny") + F.col("line") * F.col("step"))
    ends = lambda df, kind, ax, ay, bx, by, line="line": df.select("id", F.lit(kind).alias("kind"), F.col(line).alias("line") if isinstance(line, str) else line.alias("line"), F.col(ax).alias("ax"), F.col(ay).alias("ay"), F.col("z").alias("az"), F.col(bx).alias("bx"), F.col(by).alias("by"), F.col("z").alias("bz"))
    out = ends(across, "grid_x", "p", "miny", "p", "maxy").unionByName(ends(along, "grid_y", "minx", "p", "maxx", "p"))
    return out.unionByName(ends(b.where("is_stair"), "stair_diag", "minx", "miny", "maxx", "maxy", F.lit(0)))


def egress_line(floors: DataFrame, stairs: DataFrame) -> DataFrame:
    """model, seq, part and point x, y, z: from each floor of a model to the one above by the stair

    whose middle is nearest in height to the middle between them (ties to the smaller id), by way of
    the floors' centres; without a stair, by the middle itself. The nearest stair is the last one
    below or the first one above in the order of heights, so floors and stairs are not paired.
    """
    centre = [((F.col(f"min{k}") + F.col(f"max{k}")) / 2) for k in "xy"]
    c = floors.select("model", "id", centre[0].alias("x"), centre[1].alias("y"), "z")
    w = W.partitionBy("model").orderBy("z", "id")
    nexts = (F.lead(k).over(w).alias(f"n{k}") for k in "xyz")
    pair = c.select("model", "id", "x", "y", "z", F.row_number().over(w).alias("seq"), *nexts).where("nz is not null")
    middle = (F.col("z_min") + F.col("z_max")) / 2
    stair = F.min(F.struct(F.col("id").alias("stair"), centre[0].alias("sx"), centre[1].alias("sy"), middle.alias("sz"))).alias("s")
    mid = stairs.groupBy("model", middle.alias("at")).agg(stair)
    both = pair.withColumn("at", (F.col("z") + F.col("nz")) / 2).unionByName(mid, allowMissingColumns=True)
    up, down = W.partitionBy("model").orderBy("at"), W.partitionBy("model").orderBy(F.desc("at"))
    off = lambda s: F.when(s.isNotNull(), F.struct(F.abs(F.col("at") - s["sz"]).alias("off"), s.alias("s")))
    best = F.least(off(F.last("s", True).over(up)), off(F.last("s", True).over(down)))
    row = both.withColumn("best", best).where("seq is not null").withColumn("s", F.col("best.s"))
    via = (F.coalesce(F.col(f"s.s{k}"), (F.col(k) + F.col(f"n{k}")) / 2).alias(k) for k in "xyz")
    ends = (F.struct(*(F.col(f"{n}{k}").alias(k) for k in "xyz")) for n in ("", "n"))
    points = F.array(next(ends), F.struct(*via), next(ends))
    return row.select("model", "seq", F.posexplode(points).alias("part", "p")).select("model", "seq", "part", "p.*")
