import brute
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberway.llm import mixing, toxicity

pipeline = pytest.importorskip("corpus_pipeline")
tiktoken = pytest.importorskip("tiktoken")


def plain_run(spark, docs, labels):
    """(doc_id, n_tokens, ids) of run()'s rows, by plain versions of its stages; only the classifier and the draws are the operators' own."""
    model = toxicity.train(docs, labels)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    rows = [r for r, s in zip(rows, model.score(pa.array([t for _, t, _ in rows], pa.string()))) if s < pipeline.REJECTED]
    order = lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)
    best = {}
    for r in sorted(rows, key=order):
        best.setdefault("".join(brute.WORD.findall(r[1] or "")), r)
    rows = list(best.values())
    first = {}
    for r, near in sorted(zip(rows, brute.near([r[:2] for r in rows])), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        first.setdefault(near[2] if near[3] else ("alone", id(r)), r)
    rows = list(first.values())
    drawn = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k long, doc_id long, text string, source string").select("k", mixing.draw(17).alias("u")).collect()
    u = {r["k"]: r["u"] for r in drawn}
    copies = brute.mixed([(i, s, len(brute.WORD.findall(t or "")), u[i]) for i, (_, t, s) in enumerate(rows)])
    with open(pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        import base64

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=pipeline.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return sorted((str(d), coder.encode_ordinary(t or "")) for i, (d, t, _) in enumerate(rows) for _ in range(copies[i]))


def test_run_equals_a_plain_version(spark, sf, tmp_path):
    """On a table with repeated and null doc_ids, null and empty texts, near copies and clashing columns."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    prose = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    odd = [
        (None, prose("c"), "x"), (None, prose("d"), None), (90_007, prose("e"), "x"), (90_007, prose("f"), "x"), (90_001, prose("a"), "x"), (90_002, prose("a") + " more", "y"),
        (90_002, "short text", "x"), (90_003, None, "x"), (90_004, prose("e"), "y"), (90_005, prose("long", 5000), None),
    ]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, source string"))
    docs = docs.withColumn("row_key", F.lit(1)).withColumn("copies", F.lit("x")).withColumn("digest", F.lit(2.0))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r["doc_id"]), list(r["ids"])) for r in pipeline.run(spark, str(tmp_path)).collect())
    assert got == plain_run(spark, docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))


def test_run_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string, copies int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
