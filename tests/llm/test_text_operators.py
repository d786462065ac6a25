import base64

import brute
import numpy as np
import pyarrow as pa
import pytest
from brute import pairs, same
from pyspark.sql import functions as F

from emberway.llm import bpe, exact_dedup, jaccard_join, substring_dedup
from emberway.llm._words import Words, blocks
from emberway.llm.components import components

P = pytest.importorskip("public_tokenizers")
EMPTY = "doc_id long, text string, source string"


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("text", ["", "a", " a ", "a b  c\t\nd", "ab\x0b\x0ccd\r", "é ü\xa0x"])
def test_words(text):
    data = np.frombuffer(text.encode(), np.uint8)
    w = Words(data, np.array([0, len(data)]))
    assert [data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)] == brute.WORD.findall(text)


def test_words_of_several_texts_do_not_run_together():
    texts = pa.array(["ab cd", None, "", "cd ef", "ab"])
    found = []
    for _, data, offsets in blocks(texts):
        w = Words(data, offsets)
        h = w.hashes()
        found += [h[w.first[i] : w.first[i + 1]].tolist() for i in range(len(offsets) - 1)]
        assert len(w.runs(2, h)[1]) == 2
    assert found[0][1] == found[3][0] and found[0][0] == found[4][0] and found[1] == found[2] == []


def test_jaccard_join_odd(spark, odd_docs):
    same(jaccard_join.near_duplicates(odd_docs), brute.near(pairs(odd_docs)))


def test_jaccard_join_table(spark, sf):
    docs = docs_of(spark, sf)
    same(jaccard_join.near_duplicates(docs), brute.near(pairs(docs)))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_in_voronoi_regions(spark, seed):
    """Regions beyond their bound are parted by pivots, those that pivots do not part are joined by blocks; results stay exact."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(8):
        base = ["common"] * 5 + [f"g{g}w{i}" for i in range(100)]
        for k in range(9):
            own = base[:]
            for i in rng.choice(np.arange(5, 105), rng.integers(0, 3), replace=False):
                own[i] = f"c{k}"
            rows.append((len(rows), " ".join(own)))
    # one region of them all: all sets share the shingle of the common words
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near(rows)
    sets = [brute.shingles(t) for _, t in rows]
    one = spark.createDataFrame([(7, i, 0, i, len(s), 1, [7]) for i, s in enumerate(sets)], "root long, identity long, check long, node long, size long, copies long, homes array<long>")
    report = []
    found = jaccard_join.found_in(one, docs.select(F.col("doc_id").alias("identity"), F.lit(0).cast("long").alias("check"), "text"), 12, 100_000, 8, report).collect()
    assert report[0][0] == report[0][1] == 1, report
    assert report[0][2] > len(rows)  # one region, parted, some sets in several parts
    assert {(r["a"], r["n"]) for r in found if r["b"] is None} == {(d, n) for d, _, _, n in want if n}
    same(jaccard_join.near_duplicates(docs, members=4, weight=300, pivots=3), want)


def test_jaccard_join_of_alike_and_of_unlinked_sets(spark):
    """Pivots part neither: blocks give all links of a group of near copies, and none of sets that share one shingle only."""
    alike = [(i, " ".join([f"a{k}" for k in range(120)] + [f"own{i}"])) for i in range(60)]
    apart = [(100 + i, "shared by all of us " + " ".join(f"u{i}x{k}" for k in range(3 + i % 3))) for i in range(5000)]
    docs = spark.createDataFrame(alike + apart, "doc_id long, text string")
    report = []
    out = jaccard_join.near_duplicates(docs, members=16, report=report)
    same(out, [(d, len(brute.shingles(t)), 0 if d < 100 else d, 59 if d < 100 else 0) for d, t in alike + apart])
    assert report


def test_jaccard_join_by_blocks(spark):
    rows = [(i, " ".join([f"a{k}" for k in range(40)] + [f"own{i % 7}"] * (i % 5))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(jaccard_join.near_duplicates(docs, members=5, weight=120, pivots=2), brute.near(rows))


def test_words_that_collide_under_polynomials_are_told_apart(spark):
    """The Thue-Morse word and its complement are equal under any polynomial hash modulo 2**64."""
    one, other = ("".join("ab"[(bin(i).count("1") + k) % 2] for i in range(2048)) for k in (0, 1))
    rest = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{one} x"), (2, f"{other} x"), (3, f"{one} {rest}"), (4, f"{other} {rest}")], "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs).collect()}
    assert out[1] == 1 and out[2] == 2
    assert [r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()] == [0] * 4


def test_jaccard_join_empty(spark):
    assert jaccard_join.near_duplicates(spark.createDataFrame([], EMPTY)).collect() == []


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (9, 8), (8, 7), (7, 6), (6, 5), (None, 1)], "a long, b long")
    names = {r["node"]: r["label"] for r in components(links).collect()}
    assert len({names[i] for i in (1, 2, 3)}) == 1 and len({names[i] for i in (5, 6, 7, 8, 9)}) == 1 and names[1] != names[5]


def test_substring_dedup_odd(spark, odd_docs):
    out = substring_dedup.remove_repeats(odd_docs.repartition(1)).select("doc_id", "n_words", "n_removed", "kept_sha256")
    same(out, brute.repeats(pairs(odd_docs)))


@pytest.mark.parametrize("hot", [2, 512])
def test_substring_dedup_table(spark, sf, hot):
    docs = docs_of(spark, sf)
    out = substring_dedup.remove_repeats(docs, shard_bytes=50_000, hot=hot)
    assert all(brute.sha(r["kept"]) == r["kept_sha256"] for r in out.collect())
    same(out.select("doc_id", "n_words", "n_removed", "kept_sha256"), brute.repeats(pairs(docs)))


def test_substring_dedup_empty(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], EMPTY)).collect() == []


def test_exact_dedup_odd(spark, odd_docs):
    out = exact_dedup.exact_dedup(odd_docs)
    rows = pairs(odd_docs)
    same(out.select("doc_id", "keep_id", "group_size", "text_sha256"), brute.copies(rows))
    assert out.where("kept").count() == len({r[3] for r in brute.copies(rows)})
    assert out.where("kept and not doc_id <=> keep_id").count() == 0


def test_exact_dedup_is_appended_to(spark):
    index = exact_dedup.DigestIndex(spark, "index_appended", 4)
    first = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "ab")], "doc_id long, text string")
    second = spark.createDataFrame([(0, "ab"), (4, "d"), (5, "d ")], "doc_id long, text string")
    same(exact_dedup.exact_dedup(first, index).select("doc_id", "keep_id", "group_size", "kept"), [(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False)])
    same(exact_dedup.exact_dedup(second, index).select("doc_id", "keep_id", "group_size", "kept"), [(0, 1, 3, False), (4, 5, 2, False), (5, 5, 2, True)])
    assert index.read().count() == 3
    detail = {r["col_name"]: r["data_type"] for r in spark.sql("describe extended index_appended").collect()}
    assert detail["Num Buckets"] == "4" and "digest" in detail["Sort Columns"]


def test_exact_dedup_of_a_batch_that_is_run_again(spark):
    """A run lost after its digests were appended is made up for by the same batch; row keys, as they may differ, do not matter."""
    index = exact_dedup.DigestIndex(spark, "index_again", 4)
    columns = ["doc_id", "keep_id", "group_size", "kept"]
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "ab"), (4, None)], "doc_id long, text string")
    want = [(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False), (4, 4, 1, True)]
    same(exact_dedup.exact_dedup(docs, index, batch="monday").select(columns), want)
    same(exact_dedup.exact_dedup(docs.repartition(3), index, batch="monday").select(columns), want)
    same(exact_dedup.exact_dedup(docs.where("doc_id = 2"), index, batch="tuesday").select(columns), [(2, 2, 2, False)])
    index.compact()
    assert index.read().count() == 3


def test_exact_dedup_is_native(spark, odd_docs):
    plan = exact_dedup.exact_dedup(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SortMergeJoin" in plan


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], EMPTY)).collect() == []


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_texts(reference):
    import random

    coder = bpe.ByteBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = ["", " ", "\n", "a" * 5000, "é" * 999, " a  b\n\n c ", "don't  I'll", "x\x1c y\x85z", "日本語 テスト", "<|endoftext|>", "1 22 333", "!?" * 400]
    for seed in range(500):
        draw = random.Random(seed)
        texts.append("".join(draw.choice("ab 'st\n\t. é1\x1c\xa0") for _ in range(draw.randrange(40))))
    for t in texts:
        ids = coder.encode(t)
        assert ids == reference.encode_ordinary(t) and coder.decode(ids) == t.encode(), repr(t)


def test_bpe_odd(spark, odd_docs, reference):
    want = []
    for d, t in pairs(odd_docs):
        ids = reference.encode_ordinary(t or "")
        want.append((d, ids, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t or "")))
    got = bpe.encode(odd_docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    same(got, want)
    assert bpe.encode(odd_docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []


def test_bpe_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 10)
    coder = bpe.ByteBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for i in range(50):
        coder.encode(f"word{i}")
    assert len(coder.known) <= 12 and len(coder.words) <= 12


def test_contracts_of_columns(spark, sf):
    from emberway.llm.queries import QUERIES

    kinds = {
        "op3_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "n_links": "bigint"},
        "op6_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
        "op8_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
        "op9_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    }
    for name, want in kinds.items():
        got = dict(QUERIES[name](spark, sf).dtypes)
        assert want.items() <= got.items(), name


def test_pairs_helper_sees_all_rows(odd_docs):
    assert len(pairs(odd_docs)) == odd_docs.agg(F.count("*")).first()[0]
