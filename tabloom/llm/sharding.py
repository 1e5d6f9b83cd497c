"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of a source are shuffled by a seeded hash and ranked; rank r of n rows stands at (r + phase) / n, with a
phase in (0, 1) by source, so that sources of equal size do not come in bunches. Sorting all rows by that
fraction spreads every source evenly, so equal cuts of the order match the mixture.

Both ranks are prefix sums over counted buckets plus a rank inside one bucket. Buckets cut a source by hash,
so a source with a third of all rows is spread over as many tasks as its size asks for. Only narrow rows are
shuffled, never texts.

Null texts count as empty, null sources are a source of their own, repeated rows get neighbouring places.
An empty table gives an empty table. Ties of the hash are broken by id, size and checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tabloom.session import durable

SEED = 77
#: Rows that a bucket holds on average, and the largest number of buckets (beyond it buckets grow).
BUCKET_ROWS, MOST_BUCKETS = 1_000, 65_536
#: Bytes that a row takes in a shard besides its text.
ROW_BYTES = 16


def shards(docs: DataFrame, n_shards: int = 40, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """One row per document: key, size, text_crc32, source, shard (0 to n_shards - 1), slot (gapless from 0)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        (F.octet_length(whole) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
    ).withColumn("h", F.xxhash64(F.lit(seed), "key", "text_crc32"))
    narrow = durable(narrow)
    total = narrow.count()
    buckets = max(1, min(MOST_BUCKETS, total // BUCKET_ROWS))

    def bucket(unit):
        return F.least(F.floor(unit * buckets), F.lit(buckets - 1)).cast("int")

    narrow = narrow.withColumn("bucket", bucket(F.col("h") / F.lit(2.0**64) + 0.5))
    counts = narrow.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("source").alias("of_source"),
        F.col("bucket").alias("of_bucket"),
        F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("source")).alias("of_all"),
    )
    order = Window.partitionBy("source", "bucket").orderBy("h", "key", "size", "text_crc32")
    ranked = narrow.withColumn("r", F.row_number().over(order) - 1)
    ranked = ranked.join(counts, ranked["source"].eqNullSafe(counts["of_source"]) & (ranked["bucket"] == counts["of_bucket"]))
    ranked = ranked.withColumn("r", F.col("before") + F.col("r"))
    phase = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "source"), 44) + 0.5) / F.lit(float(1 << 20))
    ranked = ranked.withColumn("fraction", (F.col("r") + phase) / F.col("of_all"))
    ranked = durable(ranked.select("key", "source", "size", "text_crc32", "r", "fraction", bucket(F.col("fraction")).alias("slice")))

    slices = ranked.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # over at most MOST_BUCKETS rows
    slices = slices.select(F.col("slice").alias("of_slice"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    order = Window.partitionBy("slice").orderBy("fraction", F.col("source").asc_nulls_last(), "r")
    placed = ranked.withColumn("place", F.row_number().over(order) - 1).join(slices, F.col("slice") == F.col("of_slice"))
    place = (F.col("before") + F.col("place")).cast("long")
    # Whole-number division keeps the cuts exact: shard s begins at place ceil(s * total / n_shards).
    shard = F.expr(f"cast(place * {n_shards} div {max(total, 1)} as int)")
    begin = F.expr(f"(cast(shard as long) * {total} + {n_shards - 1}) div {n_shards}")
    placed = placed.withColumn("place", place).withColumn("shard", shard).withColumn("slot", F.col("place") - begin)
    return placed.select(F.col("key").alias(key), "size", "text_crc32", "source", "shard", "slot")
