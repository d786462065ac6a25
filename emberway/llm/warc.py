"""WARC records as a chunked table: (record_id, chunk_no) rows with incremental digests."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberway.llm._store import shared_dir, small_batches

CHUNK = 1 << 20  #: bytes of a record that one row holds at most
SENT = 4 << 20  #: bytes of chunks that go to Spark at a time
CHUNKS = "record_id string, chunk_no int, n_chunks int, page_id long, data binary, payload_so_far string"
RECORDS = "record_id string, page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, digest_ok boolean"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def typed(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: the page whose record has the same payload, null for the rest.

    Among payloads of at least `least` bytes that are equal the largest page_id holds the
    response; rows that repeat that page_id are responses too. A null html is an empty payload.
    """
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("n"))
    first = rows.where(F.col("n") >= least).groupBy("digest", "n").agg(F.max("page_id").alias("first_id"), F.count("*").alias("rows")).where("rows > 1")
    other = ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(first.hint("merge"), ["digest", "n"], "left").select("page_id", "url", "html", F.when(other, F.col("first_id")).alias("refers_to"))


def header(record: str, date: str, page_id: int | None, url: str | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """WARC/1.1 header of a record; line breaks in a url are percent-encoded, a null page_id is left out."""
    url = re.sub(r"[\r\n%]", lambda m: f"%{ord(m[0]):02X}", url or "")
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", "Content-Type: text/html"]
    lines += [f"WARC-Page-ID: {page_id}"] * (page_id is not None)
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {size if refers_to is None else 0}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def chunk_rows(pages: DataFrame, chunk: int = CHUNK, date: str | None = None) -> DataFrame:
    """Rows of CHUNKS for typed pages: a record's bytes are those of its rows in order of chunk_no.

    payload_so_far is the SHA-1, in base32, of the payload up to the row's end, carried along
    from chunk to chunk. Chunks are slices of the column's own memory; no record is copied whole.
    A row's number in its task is part of the record's id, so that equal rows are records apart.
    date is the records' WARC-Date, the time of the call unless given.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            texts = batch.column("html").cast(pa.large_string())
            _, where, what = texts.buffers()
            starts = memoryview(where).cast("q")
            view = memoryview(what) if what is not None else memoryview(b"")
            ids, urls, refs, keys = (batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "row"))
            for i, (page, url, ref, key) in enumerate(zip(ids, urls, refs, keys)):
                body = view[starts[texts.offset + i] : starts[texts.offset + i + 1]] if texts[i].is_valid else view[:0]
                states, h = [], hashlib.sha1()
                for at in range(0, max(len(body), 1), chunk):
                    h.update(body[at : at + chunk])
                    states.append(base32(h.digest()))
                record = uuid.uuid5(uuid.NAMESPACE_URL, f"{page} {url} {states[-1]} {key}").urn
                head = header(record, date, page, url, len(body), states[-1], ref)
                stored = body if ref is None else body[:0]
                pieces = [(head, 0)] + [(stored[at : at + chunk], k) for k, at in enumerate(range(0, len(stored), chunk))]
                n = max(1, len(pieces) - 1)
                for k in range(n):
                    data = (head if k == 0 else b"") + (bytes(pieces[k + 1][0]) if len(pieces) > 1 else b"") + (b"\r\n\r\n" if k == n - 1 else b"")
                    rows.append((record, k, n, page, data, states[k] if ref is None else states[-1]))
                    held += len(data)
                    if held > SENT:
                        yield _batch(rows, CHUNKS)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, CHUNKS)

    return pages.select("page_id", "url", "html", "refers_to", F.monotonically_increasing_id().alias("row")).mapInArrow(run, CHUNKS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows) if rows else ([] for _ in fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


class RecordReader:
    """Takes a record's chunks one after another and holds no more than one of them."""

    def __init__(self) -> None:
        self.fields: dict[str, str] = {}
        self.sha, self.left, self.size, self.over = hashlib.sha1(), -1, 0, b""

    def take(self, data: bytes) -> None:
        if self.left < 0:  # the header lies within the first chunk
            end = data.index(b"\r\n\r\n") + 4
            for line in data[:end].decode().split("\r\n")[1:]:
                name, _, value = line.partition(": ")
                self.fields[name] = value
            self.left = int(self.fields["Content-Length"])
            data = memoryview(data)[end:]
        body = data[: self.left]
        self.sha.update(body)
        self.size += len(body)
        self.left -= len(body)

    def row(self, record: str) -> tuple:
        f, kind = self.fields, self.fields["WARC-Type"]
        stated, n = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["WARC-Payload-Length"])
        number = lambda k: int(f[k]) if k in f else None
        found = base32(self.sha.digest()) if kind == "response" else stated
        url = re.sub(r"%(0D|0A|25)", lambda m: chr(int(m[1], 16)), f["WARC-Target-URI"])
        return record, number("WARC-Page-ID"), kind, number("WARC-Refers-To-Page-ID"), url, self.size if kind == "response" else n, found, found == stated and self.left == 0


def read_records(chunks: DataFrame) -> DataFrame:
    """Rows of RECORDS, parsed from the chunks' bytes.

    A record of one chunk is read where it lies. Only the chunks of longer records are shuffled,
    by record_id, and go through their task one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader = None, RecordReader()
        for batch in batches:
            rows = []
            for key, k, data in zip(batch.column("record_id").to_pylist(), batch.column("chunk_no").to_pylist(), batch.column("data")):
                if k == 0:
                    if now is not None:
                        rows.append(reader.row(now))
                    now, reader = key, RecordReader()
                reader.take(data.as_py())
            yield _batch(rows, RECORDS)
        if now is not None:
            yield _batch([reader.row(now)], RECORDS)

    use = chunks.select("record_id", "chunk_no", "n_chunks", "page_id", "data")
    short = use.where("n_chunks = 1").select("record_id", "chunk_no", "data").mapInArrow(run, RECORDS)
    long = use.where("n_chunks > 1").repartition("record_id", "page_id").sortWithinPartitions("record_id", "chunk_no")
    return short.unionByName(long.select("record_id", "chunk_no", "data").mapInArrow(run, RECORDS))


def write_archive(pages: DataFrame, path: str | None = None, least: int = 0, chunk: int = CHUNK) -> str:
    """Writes pages (page_id, url, html) as a chunk table and returns its path, in the shared folder unless given.

    Empty and null html give records without payload, which `least` may leave out of the
    comparison. Rows that repeat page_id, url and html give one record each; no two records have
    the same id, and ids differ from one archive to the next.
    """
    path = path or f"{shared_dir(small_batches(pages.sparkSession))}/emberway/warc-{uuid.uuid4().hex}"
    chunk_rows(typed(pages, least), chunk).write.parquet(path)
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return read_records(small_batches(spark).read.parquet(path))


def export_files(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Writes a chunk table as .warc files, one a partition, to a folder that all executors mount; (file, n_bytes).

    A file appears under its name only when complete, so that a task that runs twice does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"{folder}/part-{TaskContext.get().partitionId():05d}.warc"
        part, n = f"{name}.{uuid.uuid4().hex}", 0
        with open(part, "wb") as f:
            for batch in batches:
                for data in batch.column("data"):
                    n += f.write(data.as_buffer())
        os.replace(part, name)
        yield _batch([(name, n)], "file string, n_bytes long")

    rows = spark.read.parquet(path).repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return rows.select("data").mapInArrow(run, "file string, n_bytes long")
