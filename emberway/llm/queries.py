"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberway.llm import bpe, chat_format, exact_dedup, html_layout, jaccard_join, lexical_search, mixing, periodic_runs, substring_dedup, topk, toxicity, warc, word_bpe


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PROBE = "</s>[INST] ok [/INST]"  #: both turns of conversation -7, which looks like a template


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(PROBE).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("t")).select("t.*")
    segments, leaves = chat_format.format_chats(turns.unionByName(probe))
    return chat_format.read_back(segments).join(leaves, ["pack", "node"]).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archive(spark, warc.write_archive(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.levels(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20).select("query_id", "rank", "vec_id", "score")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, ids=False)


def op7_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False).drop("row")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


WORDS = r"[^\x20\x09-\x0D]+"


def planted(docs: DataFrame) -> DataFrame:
    """docs, of which those whose crc32(doc_id as text) ends in 0 repeat a stretch of their own words up to their end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = docs.select("*", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORDS), 0)).alias("words"))
    n = F.size("words").cast("long")
    sized = words.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    sized = sized.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    whole = lambda c: F.col(c).cast("int")
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    again = F.flatten(F.array_repeat(F.slice("words", whole("a") + 1, whole("p")), times))
    told = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), whole("a")), again), F.lit(1), whole("n")), " ")
    return sized.select("doc_id", F.when(F.col("a").isNotNull(), told).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find_runs(planted(table(spark, sf_dir, "documents")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_format, op2_warc, op3_jaccard_join, op4_toxicity, op5_exact_top_k, op6_byte_bpe, op7_html_layout, op8_exact_dedup, op9_substring_dedup, op10_mixing, op11_periodic_runs, op12_lexical_search, op13_word_bpe)
}
