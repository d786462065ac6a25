"""The sink of lines: whole or not at all, for a batch, a stream and tasks that fail."""

import pytest
from pyspark.sql import functions as F

from emberway.sources import lines


def told(spark, path):
    return sorted((r["value"] for r in lines.read_lines(spark, path).collect()), key=str)


def test_lines_come_back(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    assert told(spark, path) == []
    rows = ["a", "", None, 'two\nlines "quoted" \\', "é 漢", "a", "x" * 100_000]
    lines.write_lines(spark.createDataFrame([(x,) for x in rows], "value string").repartition(3), path)
    assert told(spark, path) == sorted(rows, key=str)
    lines.write_lines(spark.createDataFrame([("more",)], "value string"), path)
    lines.write_lines(spark.createDataFrame([], "value string"), path)
    assert told(spark, path) == sorted([*rows, "more"], key=str)


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    lines.write_lines(spark.createDataFrame([("first",)], "value string"), path)
    bad = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") == 3999, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="lost"):
        lines.write_lines(bad, path)
    assert told(spark, path) == ["first"]
    (tmp_path / "out" / "lines-half-written.txt").write_text('"half')  # as of a worker that was killed
    assert told(spark, path) == ["first"]


def test_a_micro_batch_that_runs_again_replaces_itself(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    first, again = (lines.LinesStreamWriter({"path": path}) for _ in range(2))
    rows = lambda *x: iter(spark.createDataFrame([(v,) for v in x], "value string").toArrow().to_batches())
    first.commit([first.write(rows("a", "b")), None], 7)
    lost = first.write(rows("c"))  # never committed
    again.commit([again.write(rows("a")), again.write(rows("b"))], 7)
    assert told(spark, path) == ["a", "b"] and len(list((tmp_path / "out").glob("lines-*"))) == 3
    first.abort([lost], 8)
    assert told(spark, path) == ["a", "b"] and len(list((tmp_path / "out").glob("lines-*"))) == 2


def test_a_stream_goes_on(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"file://{tmp_path}/out"
    for turn in range(2):
        spark.range(turn * 10, turn * 10 + 10).select(F.col("id").cast("string").alias("value")).write.mode("append").parquet(source)
        stream = spark.readStream.schema("value string").parquet(source)
        lines.stream_lines(stream, path, f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
        assert told(spark, path) == sorted(str(i) for i in range(turn * 10 + 10))
