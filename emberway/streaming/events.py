"""The event stream of a fire: an ordered table of events, its lines, and routes told from state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberway.operators.order import in_parts, numbered
from emberway.plans.fixpoint import cut

CHUNK = 1_000  #: rows of a step that an event tells at most


def enabled(stream_path: bool, use_temperature: bool, mode: str, start, end) -> bool:
    """Whether routes are part of a stream; an empty id counts as none."""
    return bool(stream_path and use_temperature and mode == "ifc" and start not in (None, "") and end not in (None, ""))


def _events(rows: DataFrame, rank: int, kind: str, own: list[str], body: Column, name: str) -> DataFrame:
    """An event for every part of a step: its step, part, parts, `own` values, and a body of its rows."""
    told = rows.groupBy("step", "part", "parts", *own).agg(body.alias(name))
    payload = F.to_json(F.struct("step", "part", "parts", *own, name))
    return told.select(F.col("step").cast("int"), F.lit(rank).alias("rank"), "part", F.lit(kind).alias("type"), payload.alias("payload"))


def event_table(temperatures: DataFrame, routes: DataFrame | None = None, cells: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """seq, step, rank, part, type, payload: meta (if there are cells), then per step temperature_step and, where there is one, path_update; done at the end.

    seq numbers the events densely in the order in which they are played. temperatures: step, node, t; routes: step, cost,
    changed, pos, node, a row a node. What a step has to tell comes in parts of at most `chunk` rows, an
    event each, so that neither a row nor a task holds a step: nodes by node, a path by pos, cells by all their columns.
    """
    spark = temperatures.sparkSession
    listed = lambda *c: F.sort_array(F.collect_list(F.struct("at", *c)))
    field = in_parts(temperatures.select("step", "node", "t"), ["step"], ["node"], chunk)
    entries = F.transform(listed(F.col("node").cast("string").alias("key"), "t"), lambda x: F.struct(x["key"], x["t"]))
    out = _events(field, 1, "temperature_step", [], F.map_from_entries(entries), "temperatures")
    if routes is not None:
        path = in_parts(routes.select("step", "cost", "changed", F.col("pos").alias("place"), "node"), ["step"], ["place"], chunk)
        out = out.unionByName(_events(path, 2, "path_update", ["cost", "changed"], F.transform(listed("node"), lambda x: x["node"]), "path"))
    if cells is not None:
        boxes = in_parts(cells.select(F.lit(-1).alias("step"), F.struct(*cells.columns).alias("cell")), ["step"], ["cell"], chunk)
        out = out.unionByName(_events(boxes, 0, "meta", [], F.transform(listed("cell"), lambda x: x["cell"]), "cell_bboxes"))
    done = spark.range(1).select(F.lit(2**31 - 1).alias("step"), F.lit(3).alias("rank"), F.lit(0).cast("long").alias("part"), F.lit("done").alias("type"), F.lit("{}").alias("payload"))
    return numbered(cut(out.unionByName(done)), ["step", "rank", "part"], "seq").select("seq", "step", "rank", "part", "type", "payload")


def routed(stream_path: Column, use_temperature: Column, mode: Column, start: Column, end: Column) -> Column:
    """The rule of `enabled` for a table of requests; what is null counts as not asked for."""
    return F.coalesce(stream_path & use_temperature & (mode == "ifc") & (start != "") & (end != ""), F.lit(False))


def sse_line(payload: Column) -> Column:
    """A server-sent event of a JSON payload."""
    return F.concat(F.lit("data: "), payload, F.lit("\n\n"))


def dispatched(lines: DataFrame, kind: str, schema: str) -> DataFrame:
    """Payloads of one type from lines of JSON (value: an object with `type`); what is no JSON is passed over."""
    told = lines.select(F.get_json_object("value", "$.type").alias("type"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("p"))
    return told.where(F.col("type") == kind).select("p.*")


def route_changes(routes: DataFrame) -> DataFrame:
    """session, step, path, changed from a stream of routes (session, step, path): the last path of a session is its state.

    Steps of a batch are taken in order; a step that is not above the last one seen is late and dropped.
    """
    schema = "session string, step long, path string, changed boolean"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_step, last_path = state.get if state.exists else (-1, None)
        rows = pd.concat(list(batches)).sort_values("step")
        out = []
        for step, path in zip(rows["step"], rows["path"]):
            if step > last_step:
                out.append((key[0], step, path, path != last_path))
                last_step, last_path = int(step), path
        state.update((last_step, last_path))
        yield pd.DataFrame(out, columns=["session", "step", "path", "changed"])

    return routes.groupBy("session").applyInPandasWithState(run, schema, "step long, path string", "append", GroupStateTimeout.NoTimeout)


def windowed_values(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """start, n, total: a platform capability, not one of the survey's: tumbling counts of a stream of events with a watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "n", "total")
