"""Graphs of a session by id: nodes, arcs and cells under names of their own, not of the whole process."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberway.operators import fire, graph, learning, nearest, paths
from emberway.sources.contract import BadPayload


class GraphSession:
    """Graphs registered by id as temporary views; a new graph of an id replaces that one only."""

    def __init__(self, spark: SparkSession, name: str = "default"):
        self.spark, self.name = spark, name
        self.radius: dict[str, float] = {}

    def _view(self, graph_id: str, what: str) -> str:
        return f"graph_{self.name}_{graph_id}_{what}"

    def register(self, graph_id: str, nodes: DataFrame, edges: DataFrame, cells: DataFrame | None = None, radius: float | None = None) -> None:
        """nodes: id, x, y, z; edges: src, dst, d, one row an edge; cells: bounds by cell id; radius: if the edges are all pairs of nodes within it."""
        self.radius.pop(graph_id, None)
        if radius is not None:
            self.radius[graph_id] = radius
        nodes.createOrReplaceTempView(self._view(graph_id, "node"))
        edges.createOrReplaceTempView(self._view(graph_id, "edge"))
        if cells is not None:
            cells.createOrReplaceTempView(self._view(graph_id, "cell"))

    def _table(self, graph_id: str, what: str) -> DataFrame:
        if not self.spark.catalog.tableExists(self._view(graph_id, what)):
            raise BadPayload(400, f"no graph {graph_id}")
        return self.spark.table(self._view(graph_id, what))

    def nodes(self, graph_id: str) -> DataFrame:
        return self._table(graph_id, "node")

    def edges(self, graph_id: str) -> DataFrame:
        return self._table(graph_id, "edge")

    def cells(self, graph_id: str) -> DataFrame:
        """Bounds of a graph's cells; none if it has no cells."""
        self.nodes(graph_id)
        view = self._view(graph_id, "cell")
        return self.spark.table(view) if self.spark.catalog.tableExists(view) else self.nodes(graph_id).limit(0)

    def resolve(self, graph_id: str, node=None, point: tuple[float, float, float] | None = None, vertical: str = "y"):
        """The node of an id or nearest to a point; with neither, the one nearest to the centre."""
        nodes = self.nodes(graph_id)
        if node is not None and nodes.where(F.col("id") == F.lit(node)).head(1):
            return node
        if point is None:
            row = nearest.default_start(nodes, vertical).first()
        else:
            probe = self.spark.createDataFrame([(0, *map(float, point))], "probe int, px double, py double, pz double")
            row = nearest.nearest_nodes(nodes, probe, vertical).first()
        if row is None:
            raise BadPayload(400, "the graph has no nodes")
        return row["id"]

    def path(self, graph_id: str, start_point, end_point, vertical: str = "y") -> DataFrame:
        """pos, node, x, y, z of the shortest path between the nodes nearest to two points; refuses with 404 if there is none."""
        start, end = self.resolve(graph_id, point=start_point, vertical=vertical), self.resolve(graph_id, point=end_point, vertical=vertical)
        edges = self.edges(graph_id)
        tree = paths.distances(paths.both_ways(edges, "d"), start, end=end)
        found = paths.path_to(tree, end)
        if not found.head(1):
            raise BadPayload(404, "no path")
        return found.join(self.nodes(graph_id).withColumnRenamed("id", "node"), "node").select("pos", "node", "x", "y", "z")

    def fire(self, graph_id: str, start=None, radial: bool = True, max_steps: int = 60, end=None) -> DataFrame:
        """step, part, parts, nodes: the precomputed timeline of a fire, radial or breadth first."""
        nodes, edges = self.nodes(graph_id), self.edges(graph_id)
        start = self.resolve(graph_id, node=start)
        radius = self.radius.get(graph_id)
        near = None if radius is None else graph.Within(nodes.select("id", "x", "y", "z"), radius)
        if radial:
            step = graph.step_size(near or edges, nodes).first()["step"]
            return fire.timeline(fire.radial(nodes, start, step, max_steps, end))
        return fire.timeline(fire.ignition(near or graph.arcs(edges), start, max_steps))

    def learned_route(self, graph_id: str, start=None, end=None, episodes: int = 200, max_steps: int = 200, use_fire: bool = True, seed: int = 0) -> DataFrame:
        """pos, node, x, y, z of the route that an agent learns from start to the exit `end`, while a fire spreads breadth first from its start."""
        start, end = self.resolve(graph_id, node=start), self.resolve(graph_id, node=end)
        arcs = graph.arcs(self.edges(graph_id)).withColumn("graph", F.lit(graph_id))
        kind = dict(arcs.dtypes)["src"]
        task = self.spark.range(1).select(F.lit(0).cast("long").alias("task"), F.lit(graph_id).alias("graph"), F.lit(start).cast(kind).alias("start"), F.lit(end).cast(kind).alias("exit"), F.lit(seed).cast("long").alias("seed"))
        burns = fire.ignition(arcs, start).withColumn("graph", F.lit(graph_id)) if use_fire else None
        values = learning.learn(task, arcs, burns, episodes, max_steps)
        found = learning.routes(task, arcs, values, max_steps).select("pos", "node")
        return found.join(self.nodes(graph_id).withColumnRenamed("id", "node"), "node").select("pos", "node", "x", "y", "z")
