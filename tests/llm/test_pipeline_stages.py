from collections import Counter

import pytest

from emberway.llm import mixing

pipeline = pytest.importorskip("corpus_pipeline")
DOCS = "doc_id long, text string, source string, row int, digest string, copies double"


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, s, 1, "x", 2.0) for d, t, s in rows], DOCS).repartition(3)


def texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def prose(name, n=60):
    return " ".join(f"{name}{i}" for i in range(n))


def test_exact_dedup_stage_drops_only_copies(spark):
    """Rows of one doc_id, or of none, with different texts all stay; a longer copy does not replace a shorter original."""
    long = prose("long")
    rows = [(None, "one", "a"), (None, "two", "a"), (None, "three", "a"), (7, "four", "a"), (7, "five", "b"), (1, long, "a"), (9, long, "a"), (9, "short", "a"), (3, "twice", "a"), (3, "twice", "a"), (4, "", "a"), (5, None, "a")]
    out = pipeline.drop_copies(spark, docs_of(spark, rows), "")
    assert out.columns == ["doc_id", "text", "source", "row", "digest", "copies"]
    assert texts(out) == Counter([(None, "one"), (None, "two"), (None, "three"), (7, "four"), (7, "five"), (1, long), (9, "short"), (3, "twice"), (4, "")])


def test_near_dedup_stage_drops_only_near_copies(spark):
    a, b = prose("a"), prose("b")
    rows = [(None, prose("c"), "a"), (None, prose("d"), "a"), (7, prose("e"), "a"), (7, prose("f"), "a"), (1, a, "a"), (2, a + " more", "a"), (2, "short text", "a"), (None, b, "a"), (None, b + " more", "a"), (5, "", "a"), (5, None, "a")]
    out = texts(pipeline.drop_near_copies(spark, docs_of(spark, rows), ""))
    one_of = [t for t in (b, b + " more") if out.pop((None, t), 0)]
    assert len(one_of) == 1
    assert out == Counter([(None, prose("c")), (None, prose("d")), (7, prose("e")), (7, prose("f")), (1, a), (2, "short text"), (5, ""), (5, None)])


def test_mixing_stage_counts_copies_by_row(spark):
    rows = [(None if i % 2 else i % 6, prose(f"{s}{i}x", 3 + i % 9), s) for s in "abc" for i in range(40)]
    docs = docs_of(spark, rows).persist()
    out = texts(pipeline.mix_sources(spark, docs, ""))
    words = Counter()
    for (_, t), n in out.items():
        words[t[0]] += n * len(t.split())
    told = mixing.mix(docs).groupBy("source").sum("taken").collect()
    assert words == Counter({r["source"]: r["sum(taken)"] for r in told})
