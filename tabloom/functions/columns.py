"""Schema helpers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def col(name: str) -> Column:
    """Column by exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_list(names: str | Iterable[str] | None) -> list[str]:
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric fields in schema order; booleans do not count as numeric."""
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"Columns not found: {missing}")


def require_numeric(df: DataFrame, names: Sequence[str]) -> None:
    require_columns(df, names)
    wrong = [n for n in names if not is_numeric(df, n)]
    if wrong:
        raise TypeError(f"Columns must be numeric: {wrong}")


def number(name: str) -> Column:
    """Numeric column as double, NaN as NULL."""
    value = col(name).cast("double")
    return F.when(~F.isnan(value), value)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in float columns, so that both count as missing."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({n: F.when(~F.isnan(col(n)), col(n)) for n in floats}) if floats else df


def rows_of(*structs: Column) -> Column:
    """Turn struct expressions over one row into rows (``select(rows_of(...))``)."""
    return F.inline(F.array(*structs))
