"""Interval lookup by binary search in the JVM.

A chain of comparisons per edge makes generated code that grows with the edges until the JIT refuses
it; Spark's ``Bucketizer`` searches a sorted array instead.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.columns import col


def add_slots(df: DataFrame, requests: dict[str, tuple[Column, Sequence[float]]]) -> DataFrame:
    """Per new column the number of (sorted, distinct) split points at or below the value; NULL for NULL."""
    names = list(requests)
    searched = [i for i, n in enumerate(names) if requests[n][1]]
    # Adding zero turns -0.0 into 0.0, which the search would order before it.
    result = df.withColumns({f"_x{i}": requests[n][0].cast("double") + F.lit(0.0) for i, n in enumerate(names)})
    if searched:
        result = Bucketizer(
            splitsArray=[[-math.inf, *map(float, requests[names[i]][1]), math.inf] for i in searched],
            inputCols=[f"_x{i}" for i in searched],
            outputCols=[f"_s{i}" for i in searched],
            handleInvalid="keep",
        ).transform(result)
    slots = {
        n: F.col(f"_s{i}").cast("int") if i in searched else F.when(F.col(f"_x{i}").isNotNull(), F.lit(0))
        for i, n in enumerate(names)
    }
    temporary = [f"_x{i}" for i in range(len(names))] + [f"_s{i}" for i in searched]
    return result.withColumns(slots).drop(*temporary)


def just_above(value: float) -> float:
    return math.nextafter(value, math.inf)


def add_counts_below(df: DataFrame, requests: dict[str, tuple[Column, Sequence[float]]]) -> DataFrame:
    """Per new column the number of (sorted, distinct) edges strictly below the value."""
    return add_slots(df, {n: (x, [just_above(e) for e in edges]) for n, (x, edges) in requests.items()})


def add_interval_labels(df: DataFrame, requests: dict[str, tuple[Column, Sequence[float]]]) -> DataFrame:
    """Per new column the index of the right-closed interval of the sorted edges that holds the value.

    The first interval also holds its left end. NULL values, values outside the edges and fewer than
    two edges give NULL.
    """
    usable = {n: (x, e) for n, (x, e) in requests.items() if len(e) > 1}
    labelled = add_counts_below(df, {n: (x, e[1:-1]) for n, (x, e) in usable.items()}) if usable else df
    checked = {}
    for n, (x, e) in requests.items():
        if n in usable:
            inside = (x >= F.lit(float(e[0]))) & (x <= F.lit(float(e[-1])))
            checked[n] = F.when(inside, col(n))
        else:
            checked[n] = F.lit(None).cast("int")
    return labelled.withColumns(checked)
