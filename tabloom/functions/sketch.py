"""128-bit sketches of rows, so that only rows that may repeat are compared whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

SKETCH = ["_sketch_a", "_sketch_b"]


def with_sketch(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """Adds two hashes of the columns; rows that agree on them have equal sketches, NULL being equal to NULL."""
    # Hashes skip NULLs, so their places are hashed too.
    nulls = F.concat(*(F.when(c.isNull(), "1").otherwise("0") for c in columns))
    return df.withColumns({name: F.xxhash64(F.lit(seed), nulls, *columns) for seed, name in enumerate(SKETCH)})


def repeated_sketches(sketched: DataFrame) -> DataFrame:
    """The sketches of two rows or more: the shuffle moves 16 bytes and a count per row, however wide rows are."""
    return sketched.groupBy(*SKETCH).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*SKETCH)
