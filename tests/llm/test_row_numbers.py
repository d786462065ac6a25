from itertools import count

from emberway.llm import substring_dedup


def test_repeats_go_though_partitions_change_between_jobs(spark, monkeypatch):
    """Every job deals these documents out anew, as after the loss of an executor."""
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(d, " ".join(f"d{d}w{i}" for i in range(40)) + (f" {passage}" if d % 5 == 0 else "")) for d in range(60)]
    turn, written = count(2), substring_dedup.written

    def dealt_anew(df, name, *more):
        out = written(df, name, *more)
        spark.conf.set("spark.sql.shuffle.partitions", str(next(turn)))
        return out

    monkeypatch.setattr(substring_dedup, "written", dealt_anew)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition("text")
        out = substring_dedup.remove_repeats(docs, texts=False).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["doc_id"], r["n_removed"]) for r in out) == [(d, 80 if d % 5 == 0 else 0) for d in range(60)]
