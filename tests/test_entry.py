import importlib
import sys

import pytest

import __spark_entry__


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5104


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["c3_radius_graph", "c8_gap_fill", "f1_ignition", "g7_lattice_points", "b4_product_boxes", "t3_ancestors", "s8_merged_parts"])
def test_query_matches_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = c.sql(__spark_entry__.oracle_sql()[name])
    df = __spark_entry__.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(rel.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in df.select(*rel.columns).collect()), key=key) == sorted(rel.fetchall(), key=key)


def test_library_without_the_optional_part(monkeypatch):
    for name in list(sys.modules):
        if name == "corpus_pipeline" or name.startswith("emberway.llm"):
            monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "emberway.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    fresh = importlib.reload(__spark_entry__)
    assert "c3_radius_graph" in fresh.queries() and not any(n.startswith("op") or n == "pipeline" for n in fresh.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
