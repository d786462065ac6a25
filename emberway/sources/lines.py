"""A sink of text lines for batches and streams, committed in two phases, and its reader."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

FORMAT = "emberway_lines"
MANIFEST = "_committed-"


@dataclass
class Written(WriterCommitMessage):
    """What a task tells the driver: its file, and how many lines and bytes that has."""

    name: str
    lines: int
    size: int


class _Files:
    """Files below a path of any file system that pyarrow knows by its URI; without a scheme a folder that all workers share."""

    def __init__(self, path: str):
        self.uri = path

    def at(self, name: str = "") -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(self.uri if ":" in self.uri else f"file://{self.uri}")
        return system, f"{root.rstrip('/')}/{name}" if name else root.rstrip("/")

    def put(self, name: str, blocks: Iterator[bytes]) -> int:
        system, path = self.at(name)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        size = 0
        with system.open_output_stream(path) as out:
            for block in blocks:
                size += out.write(block)
        return size

    def drop(self, name: str) -> None:
        system, path = self.at(name)
        if system.get_file_info(path).type != fs.FileType.NotFound:
            system.delete_file(path)


class _Tasks:
    """The tasks' part of a write: each attempt writes a file of a name of its own, which no reader sees before it is committed."""

    def __init__(self, options: dict):
        self.files, self.job = _Files(options["path"]), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name, lines = f"lines-{self.job}-{uuid.uuid4().hex}.txt", 0

        def blocks() -> Iterator[bytes]:
            nonlocal lines
            for batch in iterator:
                lines += batch.num_rows
                yield "".join(f"{json.dumps(x, ensure_ascii=False)}\n" for x in batch.column(0).to_pylist()).encode()

        try:
            size = self.files.put(name, blocks())
        except BaseException:
            self.files.drop(name)  # a task that is killed outright leaves a file that no manifest names
            raise
        return Written(name, lines, size)

    def publish(self, manifest: str, messages: list) -> None:
        """The second phase: one small file that names all files of the write. A manifest of the same name is replaced, and its files go."""
        system, path = self.files.at(MANIFEST + manifest)
        before = []
        if system.get_file_info(path).type == fs.FileType.File:
            with system.open_input_stream(path) as f:
                before = json.loads(f.read())["files"]
        told = [{"name": m.name, "lines": m.lines, "size": m.size} for m in messages if m is not None and m.lines]
        waiting = f"_waiting-{self.job}-{manifest}"
        self.files.put(waiting, iter([json.dumps({"files": told}).encode() + b"\n"]))
        system.move(self.files.at(waiting)[1], path)
        for old in before:
            self.files.drop(old["name"])

    def withdraw(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                self.files.drop(m.name)


class LinesWriter(_Tasks, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        self.publish(f"job-{self.job}", messages)

    def abort(self, messages: list) -> None:
        self.withdraw(messages)


class LinesStreamWriter(_Tasks, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.publish(f"batch-{batchId:012d}", messages)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.withdraw(messages)


class Lines(DataSource):
    """Format emberway_lines: appends rows of one string column to the folder `path`.

    A line is stored as a JSON string, so that any text, line breaks and nulls too, comes back as it was. A batch's
    or micro-batch's lines are there all together once its manifest is, and not at all before. A micro-batch
    that is run again replaces itself.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return StructType().add("value", StringType())

    def writer(self, schema: StructType, overwrite: bool) -> LinesWriter:
        if overwrite:
            raise ValueError("lines are only appended")
        return LinesWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> LinesStreamWriter:  # noqa: N802
        return LinesStreamWriter(self.options)


def write_lines(lines: DataFrame, path: str) -> None:
    """Appends lines (one string column) to a folder that all workers share."""
    lines.sparkSession.dataSource.register(Lines)
    lines.write.format(FORMAT).mode("append").option("path", path).save()


def stream_lines(lines: DataFrame, path: str, checkpoint: str):
    """A DataStreamWriter that appends a stream of lines to the folder, each micro-batch once."""
    lines.sparkSession.dataSource.register(Lines)
    return lines.writeStream.format(FORMAT).option("path", path).option("checkpointLocation", checkpoint)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of all committed writes of a folder, in no order."""
    system, root = _Files(path).at()
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    names = []
    for info in found:
        if info.base_name.startswith(MANIFEST):
            with system.open_input_stream(info.path) as f:
                names += [f"{path.rstrip('/')}/{x['name']}" for x in json.loads(f.read())["files"]]
    if not names:
        return spark.createDataFrame([], "value string")
    return spark.read.text(names).select(F.from_json(F.concat(F.lit('{"value":'), "value", F.lit("}")), "value string")["value"].alias("value"))
