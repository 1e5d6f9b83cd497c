"""The queries of this package over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.llm import benchmark_scan, byte_bpe, cap_filters, html_text, licenses, mixing, ngram_join, prefix_trie, quality, sharding, spelling, sql, suffix_dedup, toxicity
from tabloom.queries import Registry, table

registry = Registry()


@registry.add("op1_html_extraction")
def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html_text.main_text(pages, html_text.learn(pages))


@registry.add("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, folder, "documents").select("doc_id", "text"))


@registry.add("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


@registry.add("op4_ngram_join")
def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


@registry.add("op5_toxicity")
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    docs = table(spark, folder, "documents").select("doc_id", "text").withColumn("held_out", held_out)
    labels = table(spark, folder, "labels").where(~held_out)
    model = toxicity.train(docs.where("not held_out"), labels)
    scored = toxicity.scores(docs, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@registry.add("op6_quality_rules", sql.quality_rules())
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    judged = quality.verdicts(quality.repetition(docs))
    return judged.select(*first, *(c for c in judged.columns if c not in (*first, "text")))


@registry.add("op7_mixing", sql.source_mix())
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.repetition(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "copies")


@registry.add("op8_sharding")
def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shards(table(spark, folder, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


@registry.add("op9_license_scan")
def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@registry.add("op10_cap_filters")
def op10_cap_filters(spark: SparkSession, folder: str) -> DataFrame:
    return cap_filters.near_duplicates(table(spark, folder, "embeddings"))


@registry.add("op11_conversation_trie", sql.conversation_trie())
def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    own = prefix_trie.sequences(table(spark, folder, "conversations"))
    return prefix_trie.trie(prefix_trie.with_shared_openings(own)).drop("turn_id")


@registry.add("op12_spelling_variants", sql.spelling_variants())
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents").select("doc_id", "text"))


@registry.add("op13_benchmark_scan", sql.benchmark_scan())
def op13_benchmark_scan(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark_scan.contaminated(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
