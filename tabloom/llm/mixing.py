"""Mixing sources to target weights: whole-number repetition plus one seeded coin for the fraction.

Sizes are words. Sources weigh 1, 2, 3, 1, … in code-point order (null last). Targets share the total size
by weight; a target stops at ``LIMIT`` times its source's size and the excess goes to the others by weight.

Null texts have size 0, empty sources a target of 0; rows with equal ids get equal decisions. An empty table
gives an empty table. Columns of the documents pass through; a clash with an added name raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabloom.session import durable

LIMIT = 3
SEED = 20_240


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and the control characters 9 to 13."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: source, source_size, target. ``sizes`` has source and size.

    min(LIMIT * size, level * weight) for the one level at which the targets sum to the total: sources in
    order of LIMIT * size / weight reach their stop first, so prefix sums over that order give the level.
    The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")).withColumn("stop", LIMIT * F.col("source_size").cast("double"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    # The weights from a source on, as a running sum in the opposite order: a frame that ends at the last row is added anew for every row.
    onward = Window.orderBy((F.col("stop") / F.col("weight")).desc(), F.col("source").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(upto), F.lit(0.0))) / F.sum("weight").over(onward)
    # The level is the first that its own source, and so all later ones, can take in full.
    levels = per.withColumn("level", F.when(level * F.col("weight") <= F.col("stop"), level))
    found = F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("target", F.least("stop", found * F.col("weight"))).select("source", "source_size", "target")


def repetition(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` with size, source_size, target and copies (how often the mix takes the document)."""
    if clash := {c.lower() for c in docs.columns} & {"size", "source_size", "target", "copies"}:
        raise ValueError(f"Columns have the names of results: {sorted(clash)}")
    sized = docs.withColumn("size", n_words(F.col(text)))
    # A stored table of one row per source: its size is known to the planner before it may be broadcast.
    wanted = durable(targets(sized.select(F.col(source).alias("source"), "size"))).withColumnRenamed("source", "of_source")
    rate = F.coalesce(F.least(F.col("target") / F.col("source_size"), F.lit(float(LIMIT))), F.lit(0.0))
    # The first 52 bits of a seeded hash as a number in [0, 1); the same on every engine.
    coin = F.conv(F.substring(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(SEED)))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    copies = F.floor(rate) + (coin < rate - F.floor(rate)).cast("long")
    joined = sized.join(wanted, sized[source].eqNullSafe(wanted["of_source"])).drop("of_source")
    return joined.withColumn("copies", copies)


def mixed(docs: DataFrame, **names: str) -> DataFrame:
    """The mix: each document ``copies`` times, with the columns of ``docs``."""
    return repetition(docs, **names).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(docs.columns)
