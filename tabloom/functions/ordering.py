"""Exact order-dependent computation without a single-task sort.

A window with no partition key, or with one hot key, sorts all its rows in one task. Here rows are
range-partitioned on (keys, order), which splits a hot key over many tasks; the row number inside a
range partition plus the sizes of the partitions before it is the global position. The sorted rows
are stored first, so positions cannot change when an executor is lost. Blocks of equal row counts
cut from the positions are then the unit of parallel work.

``order_by`` must tell rows apart within a partition key (add a tie-break column).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabloom.functions.columns import as_list, col
from tabloom.session import durable

POSITION, BLOCK = "_position", "_block"
SMALLEST_BLOCK = 5_000
LARGEST_BLOCK = 2_000_000
MOST_BLOCKS = 65_536
GROUP_ROWS = 1_000_000
"""Largest group that one task of a plain window may sort."""


@dataclass
class Numbered:
    """Stored rows with their 0-based position in the order, and the number of rows."""

    rows: DataFrame
    total: int

    def block_rows(self, at_least: int = 1) -> int:
        parallelism = self.rows.sparkSession.sparkContext.defaultParallelism
        wanted = -(-self.total // (2 * parallelism))
        largest = max(LARGEST_BLOCK, -(-self.total // MOST_BLOCKS))
        return max(min(max(wanted, SMALLEST_BLOCK), largest), at_least)


def number_rows(df: DataFrame, order_by: Sequence[str | Column], name: str = POSITION) -> Numbered:
    """Give every row its global position in ``order_by``; one range shuffle, no global window."""
    keys = [col(o) if isinstance(o, str) else o for o in order_by]
    stored = durable(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    # The id holds the range partition in its upper bits and the row inside it in the lower 33.
    part = F.shiftright("_row", 33)
    sizes = sorted(stored.groupBy(part.alias("part")).count().collect())
    starts = [0, *accumulate(s["count"] for s in sizes)]
    table = df.sparkSession.createDataFrame(
        [(s["part"], start) for s, start in zip(sizes, starts)], "_part long, _start long"
    )
    # One row per range partition, so never more rows than shuffle partitions.
    numbered = (
        stored.withColumn("_part", part)
        .join(F.broadcast(table), "_part")
        .withColumn(name, F.col("_start") + F.col("_row").bitwiseAND(2**33 - 1))
        .drop("_part", "_start", "_row")
    )
    return Numbered(numbered, starts[-1])


def small_groups(df: DataFrame, partition_by: Sequence[str], limit: int) -> bool:
    """Whether every group is small enough for one task (one map-side combined count)."""
    if not partition_by:
        return False
    largest = df.groupBy(*map(col, partition_by)).count().agg(F.max("count")).first()[0]
    return (largest or 0) <= limit


def over_neighbours(
    df: DataFrame,
    build: Callable[[object, Callable], dict[str, Column]],
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] | None = None,
    before: int = 0,
    after: int = 0,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Add columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``build(window)`` returns the new columns for an ordered window. When every group fits one task
    a plain window does it. Otherwise the rows are cut into blocks and each block receives copies of
    its neighbours' nearest rows, which are dropped afterwards.
    """
    order, groups = as_list(order_by), as_list(partition_by)
    if small_groups(df, groups, group_rows):
        window = Window.partitionBy(*map(col, groups)).orderBy(*map(col, order))
        return df.withColumns(build(window))
    numbered = number_rows(df, [*groups, *order])
    size = numbered.block_rows(at_least=max(before, after, 1))
    home = F.floor(F.col(POSITION) / size)
    offset = F.col(POSITION) % size
    ends, starts = offset >= size - before, offset < after
    targets = (
        F.when(ends & starts, F.array(home, home + 1, home - 1))
        .when(ends, F.array(home, home + 1))
        .when(starts, F.array(home, home - 1))
        .otherwise(F.array(home))
    )
    window = Window.partitionBy(BLOCK, *map(col, groups)).orderBy(POSITION)
    return (
        numbered.rows.withColumn(BLOCK, F.explode(targets))
        .withColumns(build(window))
        .where(F.col(BLOCK) == home)
        .drop(BLOCK, POSITION)
    )


def fill_from_neighbours(
    df: DataFrame,
    columns: Sequence[str],
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] | None = None,
    forward: bool = True,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Replace NULLs by the nearest earlier (``forward``) or later non-null value of the group."""
    order, groups = as_list(order_by), as_list(partition_by)

    def walked(name: str) -> Column:
        # A frame to the end of the group is computed anew for every row, so backward fills walk down from the last row.
        return F.col(name) if forward else F.col(name).desc()

    if small_groups(df, groups, group_rows):
        window = Window.partitionBy(*map(col, groups))
        # Rows that the order doesn't tell apart keep their places when they are walked backwards.
        rows = df if forward else df.withColumn(POSITION, F.row_number().over(window.orderBy(*map(col, order))))
        reach = window.orderBy(*(map(col, order) if forward else [walked(POSITION)])).rowsBetween(Window.unboundedPreceding, 0)
        filled = {c: F.last(col(c), ignorenulls=True).over(reach) for c in columns}
        return rows.withColumns(filled).select(*map(col, df.columns))
    numbered = number_rows(df, [*groups, *order])
    size = numbered.block_rows()
    rows = numbered.rows.withColumn(BLOCK, F.floor(F.col(POSITION) / size))
    # What a block hands on: its last (first) non-null value per column, with the group it is from.
    edge = F.max_by if forward else F.min_by
    handed = rows.groupBy(BLOCK).agg(
        *[
            edge(
                F.struct(*[col(g).alias(f"g{i}") for i, g in enumerate(groups)], col(c).alias("v")),
                F.when(col(c).isNotNull(), F.col(POSITION)),
            ).alias(f"_carry{i}")
            for i, c in enumerate(columns)
        ]
    )
    # One row per block, at most MOST_BLOCKS rows: small enough for one task.
    across = Window.orderBy(walked(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = handed.select(
        BLOCK,
        *[F.last(f"_carry{i}", ignorenulls=True).over(across).alias(f"_carry{i}") for i in range(len(columns))],
    )
    window = Window.partitionBy(BLOCK, *map(col, groups)).orderBy(walked(POSITION)).rowsBetween(Window.unboundedPreceding, 0)
    filled = {}
    for i, c in enumerate(columns):
        carry = F.col(f"_carry{i}")
        same = F.lit(True)
        for j, g in enumerate(groups):
            same = same & carry[f"g{j}"].eqNullSafe(col(g))
        filled[c] = F.coalesce(F.last(col(c), ignorenulls=True).over(window), F.when(same, carry["v"]))
    # The table has a row per block but may have many columns: whether to broadcast it is the planner's choice.
    return (
        rows.join(carried, BLOCK, "left")
        .withColumns(filled)
        .select(*map(col, df.columns))
    )


def running_totals(
    df: DataFrame,
    order_by: str | Sequence[str],
    values: dict[str, str],
    partition_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Inclusive running sums: ``values`` maps a new column to the column it sums."""
    order, groups = as_list(order_by), as_list(partition_by)
    numbered = number_rows(df, [*groups, *order])
    rows = numbered.rows.withColumn(BLOCK, F.floor(F.col(POSITION) / numbered.block_rows()))
    keys = [BLOCK, *groups]
    per_block = rows.groupBy(*map(col, keys)).agg(*[F.sum(col(v)).alias(n) for n, v in values.items()])
    # At most one row per block and one per group, never a row per input row.
    earlier = Window.partitionBy(*map(col, groups)).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select(
        *[col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_s{i}") for i, n in enumerate(values)],
    )
    inside = Window.partitionBy(*map(col, keys)).orderBy(POSITION).rowsBetween(Window.unboundedPreceding, 0)
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & col(k).eqNullSafe(F.col(f"_k{i}"))
    summed = rows.withColumns({n: F.sum(col(v)).over(inside) for n, v in values.items()})
    return summed.join(starts, match).select(
        *map(col, df.columns),
        *[(F.col(n) + F.col(f"_s{i}")).alias(n) for i, n in enumerate(values)],
    )
