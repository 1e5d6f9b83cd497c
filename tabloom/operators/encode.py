"""Label and one-hot encoding of categories."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from tabloom.functions.columns import as_list, col, require_columns
from tabloom.functions.ordering import number_rows

BROADCAST_CATEGORIES = 100_000
CATEGORY_BYTES = 32 * 1024 * 1024
ONE_HOT_CATEGORIES = 1_000


def distinct_values(df: DataFrame, column: str, limit: int) -> list[Any] | None:
    """Sorted distinct non-null values, or None when there are more than ``limit`` or they are long.

    The values are measured before they are collected.
    """
    values = df.where(col(column).isNotNull()).select(col(column).alias("v")).distinct()
    n, size = values.agg(F.count("*"), F.sum(F.octet_length(F.col("v").cast("string")))).first()
    if n > limit or (size or 0) > CATEGORY_BYTES:
        return None
    return sorted(r["v"] for r in values.collect())


def category_codes(df: DataFrame, column: str) -> tuple[DataFrame, bool]:
    """Table ``(_value, _code)`` of sorted distinct values and 0-based codes; whether it is small."""
    values = distinct_values(df, column, BROADCAST_CATEGORIES)
    kind = df.schema[column].dataType.simpleString()
    if values is not None:
        rows = [(v, i) for i, v in enumerate(values)]
        return df.sparkSession.createDataFrame(rows, f"_value {kind}, _code int"), True
    distinct = df.where(col(column).isNotNull()).select(col(column).alias("_value")).distinct()
    return number_rows(distinct, ["_value"], name="_code").rows.withColumn("_code", F.col("_code").cast("int")), False


def label_encode(df: DataFrame, columns: str | Sequence[str], suffix: str = "") -> DataFrame:
    """Codes 0..k-1 in sorted order of the values, NULL gives -1.

    With ``suffix`` the code goes to a new column ``{column}{suffix}`` and the source stays.
    """
    names = as_list(columns)
    require_columns(df, names)
    result = df
    for i, name in enumerate(names):
        codes, small = category_codes(df, name)
        codes = codes.select(F.col("_value").alias(f"_v{i}"), F.col("_code").alias(f"_c{i}"))
        # Beyond the checked size the join strategy is left to the adaptive planner.
        joined = result.join(F.broadcast(codes) if small else codes, col(name) == F.col(f"_v{i}"), "left")
        result = joined.withColumn(name + suffix, F.coalesce(f"_c{i}", F.lit(-1))).drop(f"_v{i}", f"_c{i}")
    return result


def one_hot_encode(
    df: DataFrame, columns: str | Sequence[str], as_type: str = "boolean", max_categories: int = ONE_HOT_CATEGORIES
) -> DataFrame:
    """Replace each column by one indicator column ``{column}_{value}`` per value; NULL is all off."""
    names = as_list(columns)
    require_columns(df, names)
    indicators = []
    for name in names:
        values = distinct_values(df, name, max_categories)
        if values is None:
            raise ValueError(f"Column '{name}' has more than {max_categories} values (or very long ones); encode it as labels instead.")
        for v in values:
            hit = F.coalesce(col(name) == F.lit(v), F.lit(False))
            indicators.append(hit.cast(as_type).alias(f"{name}_{v}"))
    return df.select(*[col(c) for c in df.columns if c not in names], *indicators)


def encode_categoricals(df: DataFrame, columns: Sequence[str], method: str = "label") -> DataFrame:
    """Encode in place: label codes, or boolean one-hot columns."""
    if method == "label":
        return label_encode(df, columns)
    if method == "onehot":
        return one_hot_encode(df, columns)
    raise ValueError(f"Unknown encoding method '{method}'. Use 'label' or 'onehot'.")


def categorical_encoding(df: DataFrame, columns: Sequence[str], method: str = "onehot") -> DataFrame:
    """Encode as features: codes in ``{column}_encoded``, or 0/1 one-hot columns."""
    if method == "label":
        return label_encode(df, columns, suffix="_encoded")
    if method == "onehot":
        return one_hot_encode(df, columns, as_type="int")
    raise ValueError(f"Unknown encoding method '{method}'. Use 'label' or 'onehot'.")
