"""A fire that spreads as a stream: every micro-batch is a level, state by node tells what burns already."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberway.operators import tiles
from emberway.operators.graph import Within


class FireStream:
    """Breadth-first fire over arcs (src, dst), from messages (node, step) in a shared folder that it writes back to itself.

    folder/messages holds what reached a node at which step, folder/levels the nodes that then caught
    fire, one directory a micro-batch; folder/state is the stream's checkpoint. A batch takes the messages that
    lie there, keeps those of nodes that do not burn yet, writes them as a level, and their
    neighbours as the next messages. Both directories are overwritten when a batch is run again after a
    failure, before any later batch reads them, so a stream that was stopped or lost at any point goes
    on from its checkpoint and has every node once.
    """

    def __init__(self, arcs: DataFrame | Within, folder: str, max_steps: int = 60):
        near = isinstance(arcs, Within)
        self.spark: SparkSession = (arcs.points if near else arcs).sparkSession
        self.arcs, self.folder, self.max_steps = arcs if near else arcs.select("src", "dst"), folder.rstrip("/"), max_steps
        kind = arcs.kind if near else dict(arcs.dtypes)["src"]
        self.schema = f"node {kind}, step int"

    def ignite(self, *nodes) -> None:
        """Sets nodes on fire at step 0."""
        rows = self.spark.createDataFrame([(n, 0) for n in nodes], self.schema)
        rows.write.mode("append").parquet(f"{self.folder}/messages/begun")

    def levels(self) -> DataFrame:
        """node, step of what burns by now."""
        path = f"{self.folder}/levels"
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(path)

    def _level(self, caught: DataFrame, batch: int) -> None:
        level, out = f"{self.folder}/levels/batch-{batch}", f"{self.folder}/messages/batch-{batch}"
        caught.write.mode("overwrite").parquet(level)
        caught = self.spark.read.schema(self.schema).parquet(level)
        reached = caught.where(F.col("step") < self.max_steps)
        if isinstance(self.arcs, Within):
            reached = self.arcs.folded(reached.select(F.col("node").alias("src"), "step"), tiles.least_step, self.schema)
        else:
            reached = reached.join(self.arcs, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg((F.min("step") + 1).alias("step"))
        if caught.head(1):  # an empty file would be a message of its own
            reached.write.mode("overwrite").parquet(out)

    def start(self, once: bool = False) -> StreamingQuery:
        """Starts the stream, or goes on with it; once: only with what lies there now, which is one level."""
        messages = self.spark.readStream.schema(self.schema).option("recursiveFileLookup", True).parquet(f"{self.folder}/messages")
        caught = messages.groupBy("node").applyInPandasWithState(_first, self.schema, "step int", "append", GroupStateTimeout.NoTimeout)
        writer = caught.writeStream.foreachBatch(self._level).option("checkpointLocation", f"{self.folder}/state")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="0 seconds")).start()

    def burn_out(self) -> DataFrame:
        """levels() once nothing else catches fire."""
        query = self.start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return self.levels()


def _first(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A node's first message; of several in a batch that of the least step."""
    step = min(int(b["step"].min()) for b in batches)
    if not state.exists:
        state.update((step,))
        yield pd.DataFrame({"node": [key[0]], "step": [step]})
